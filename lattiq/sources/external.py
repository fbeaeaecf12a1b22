"""Readers of public disease and finding collections, one a family; each gives distinct edges (d, p).

Collections name things in their own ways, so readers take tables of codes (scheme, code, concept) and of names
(name, concept), and the universes of diseases and findings (x). Schemes: ``evidence``, ``mesh``, ``doid``, ``hpo``.
A code or name may have several concepts; each makes an edge. Rows that are too short or name nothing known are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.sources.readers import read_rrf

#: Predicates of subject and object that make an edge (fixed values).
PREDICATES = ("PROCESS_OF", "CAUSES", "MANIFESTATION_OF", "ASSOCIATED_WITH", "AFFECTS", "OCCURS_IN", "PREDISPOSES", "COMPLICATES")


def oriented(pairs: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges of pairs (a, b) in either order: a finding first if a is a finding and b a disease, else the other way."""
    mark = lambda x, c, flag: x.select(F.col("x").alias(c)).distinct().withColumn(flag, F.lit(True))
    x = pairs.select("a", "b").distinct()
    for c in "ab":
        x = x.join(mark(diseases, c, f"_d{c}"), c, "left").join(mark(findings, c, f"_f{c}"), c, "left")
    edge = lambda d, p: F.struct(F.col(d).alias("d"), F.col(p).alias("p"))
    e = F.when(F.col("_fa") & F.col("_db"), edge("b", "a")).when(F.col("_fb") & F.col("_da"), edge("a", "b"))
    return x.select(e.alias("e")).where("e IS NOT NULL").select("e.*").distinct()


def directed(pairs: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges of pairs (d, p) whose two sides are known."""
    d, p = diseases.select(F.col("x").alias("d")), findings.select(F.col("x").alias("p"))
    return pairs.select("d", "p").distinct().join(d, "d", "left_semi").join(p, "p", "left_semi").select("d", "p")


def _coded(rows: DataFrame, codes: DataFrame, scheme: str, column: str, out: str) -> DataFrame:
    c = codes.where(F.col("scheme") == scheme).select(F.col("code").alias(column), F.col("concept").alias(out)).distinct()
    return rows.join(c, column).drop(column)


def _named(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    n = names.select(F.trim(F.lower("name")).alias("_name"), F.col("concept").alias(out)).distinct()
    return rows.withColumn("_name", F.trim(F.lower(column))).join(n, "_name").drop("_name", column)


def _cells(spark: SparkSession, path: str, sep: str, comment: str | None = None) -> tuple[DataFrame, Column]:
    """Lines of unquoted cells: (rows, cells)."""
    x = spark.read.text(path)
    x = x.where(~F.col("value").startswith(comment)) if comment else x
    return x, F.split("value", sep)


def condition_edges(spark: SparkSession, path: str, names: DataFrame, codes: DataFrame) -> DataFrame:
    """A JSON object of conditions by name, each with objects ``symptoms`` and ``antecedents`` by evidence code.

    The file is one value (a few thousand conditions)."""
    kind = "map<string,struct<symptoms:map<string,string>,antecedents:map<string,string>>>"
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("name", "v"))
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    x = x.select("name", F.explode(F.concat(keys(F.col("v.symptoms")), keys(F.col("v.antecedents")))).alias("code"))
    return _coded(_named(x, names, "name", "d"), codes, "evidence", "code", "p").select("d", "p").distinct()


def predication_edges(spark: SparkSession, path: str, diseases: DataFrame, findings: DataFrame, predicates=PREDICATES) -> DataFrame:
    """Comma-separated predications without a header: predicate in the fourth, subject in the fifth, object in the ninth of twelve columns."""
    shape = ", ".join(f"c{i} string" for i in range(12))
    x = spark.read.csv(path, schema=shape, quote='"', escape='"', encoding="ISO-8859-1").where(F.col("c3").isin(*predicates) & F.col("c11").isNotNull())
    return oriented(x.select(F.col("c4").alias("a"), F.col("c8").alias("b")), diseases, findings)


def relation_edges(spark: SparkSession, path: str, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Relation rows (RRF) of any kind between a finding and a disease."""
    return oriented(read_rrf(spark, path, "rel").select(F.col("cui1").alias("a"), F.col("cui2").alias("b")), diseases, findings)


def knowledge_base_edges(spark: SparkSession, path: str, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Comma-separated (disease, count, finding), each side beginning with ``UMLS:`` and its concept."""
    x = spark.read.csv(path, schema="a string, n string, b string", quote='"', escape='"')
    concept = lambda c: F.nullif(F.regexp_extract(c, r"^UMLS:(C\d+)", 1), F.lit(""))
    return oriented(x.select(concept("b").alias("a"), concept("a").alias("b")).dropna(), diseases, findings)


def symptom_network_edges(spark: SparkSession, path: str, codes: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Tab-separated with a header: the disease's MeSH code in the fifth column, the symptom's in the sixth."""
    x, f = _cells(spark, path, "\t")
    x = x.select(F.get(f, 4).alias("dm"), F.get(f, 5).alias("pm")).dropna()  # the header names no code
    both = _coded(_coded(x, codes, "mesh", "dm", "b"), codes, "mesh", "pm", "a")
    return oriented(both, diseases, findings)


def statement_edges(spark: SparkSession, path: str, codes: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Comma-separated with a header, columns disease_umls, symptom_umls, disease_mesh, symptom_mesh in any order.

    Concepts count in either order, MeSH codes as disease and symptom only."""
    x = spark.read.csv(path, header=True, quote='"', escape='"')
    cell = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = x.select(cell("symptom_umls").alias("a"), cell("disease_umls").alias("b")).dropna()
    mesh = x.select(cell("disease_mesh").alias("dm"), cell("symptom_mesh").alias("pm")).dropna()
    mapped = _coded(_coded(mesh, codes, "mesh", "dm", "d"), codes, "mesh", "pm", "p")
    return oriented(own, diseases, findings).unionByName(directed(mapped, diseases, findings)).distinct()


def network_edges(spark: SparkSession, path: str, codes: DataFrame, terms: DataFrame, names: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Tab-separated (Disease::DOID, kind, Symptom::MeSH); a DOID without a known disease goes by its name in ``terms`` (code, name)."""
    x, f = _cells(spark, path, "\t")
    strip = lambda c, head: F.regexp_replace(c, f"^{head}::", "")
    x = x.select(strip(F.get(f, 0), "Disease").alias("doid"), strip(F.get(f, 2), "Symptom").alias("pm")).dropna().distinct()
    known = diseases.select(F.col("x").alias("d")).distinct()
    by_code = codes.where("scheme = 'doid'").select(F.col("code").alias("doid"), F.col("concept").alias("d")).distinct().join(known, "d", "left_semi")
    rest = terms.select(F.col("code").alias("doid"), "name").join(by_code, "doid", "left_anti")
    by_name = _named(rest, names, "name", "d").join(known, "d", "left_semi")
    every = by_code.select("doid", "d").unionByName(by_name.select("doid", "d"))
    return directed(_coded(x.join(every, "doid"), codes, "mesh", "pm", "p"), diseases, findings)


def phenotype_graph_edges(spark: SparkSession, path: str, codes: DataFrame, names: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Comma-separated with a header: rows whose display_relation is ``phenotype present`` between a disease, by its name,
    and a phenotype, by its number; the disease stands on either side, numbers of groups are left out."""
    x = spark.read.csv(path, header=True, quote='"', escape='"').where("display_relation = 'phenotype present'")
    first, second = F.col("x_type") == "disease", F.col("y_type") == "disease"
    name = F.when(first, F.col("x_name")).when(second, F.col("y_name"))
    number = F.when(first, F.col("y_id")).when(second, F.col("x_id"))
    x = x.select(name.alias("name"), number.alias("n")).where(F.col("name").isNotNull() & F.col("n").rlike(r"^\d+$"))
    x = x.select("name", F.concat(F.lit("HP:"), F.lpad("n", F.greatest(F.length("n"), F.lit(7)), F.lit("0"))).alias("hpo"))
    return directed(_coded(_named(x, names, "name", "d"), codes, "hpo", "hpo", "p"), diseases, findings)


def mapping_edges(spark: SparkSession, path: str, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Pipe-separated with # comments: the disease's concept in the first, the finding's in the fifth of six columns."""
    x, f = _cells(spark, path, r"\|", "#")
    return directed(x.where(F.size(f) >= 6).select(F.get(f, 0).alias("d"), F.get(f, 4).alias("p")), diseases, findings)


def annotation_edges(spark: SparkSession, path: str, codes: DataFrame, names: DataFrame, diseases: DataFrame, findings: DataFrame) -> DataFrame:
    """Tab-separated annotations with # comments: the disease by name, rows with qualifier NOT left out, the phenotype by code."""
    x, f = _cells(spark, path, "\t", "#")
    x = x.where((F.size(f) >= 4) & (F.get(f, 2) != "NOT")).select(F.get(f, 1).alias("name"), F.get(f, 3).alias("hpo"))
    return directed(_coded(_named(x, names, "name", "d"), codes, "hpo", "hpo", "p"), diseases, findings)
