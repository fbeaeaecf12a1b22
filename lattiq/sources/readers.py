"""Typed readers. Every schema is explicit; nothing is inferred or evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.functions.text import token_base, token_value

RRF = {
    "conso": ["cui", "lat", "ts", "lui", "stt", "sui", "ispref", "aui", "saui", "scui", "sdui", "sab", "tty", "code", "str", "srl", "suppress", "cvf"],
    "sty": ["cui", "tui", "stn", "sty", "atui", "cvf"],
    "rel": ["cui1", "aui1", "stype1", "rel", "cui2", "aui2", "stype2", "rela", "rui", "srui", "sab", "sl", "rg", "dir", "suppress", "cvf"],
}


def py_list(c: Column, schema: str = "array<string>") -> Column:
    """A Python list literal as an array; it is parsed, never evaluated. Single quotes are accepted."""
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})


def read_patients(spark: SparkSession, path: str, severity: DataFrame | None = None, level: int | None = None, first: int | None = None) -> DataFrame:
    """Patients in file order (ord): severity (pathology, severity) filters, then the first so many kept rows.

    ord (file, block, row) orders rows by their file's name, then by their place in it."""
    names = ["AGE", "DIFFERENTIAL_DIAGNOSIS", "SEX", "PATHOLOGY", "EVIDENCES", "INITIAL_EVIDENCE"]
    shape = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, header=True, schema=shape, quote='"', escape='"', enforceSchema=False)
    df = df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_at"))
    pairs = F.transform(py_list(F.col("DIFFERENTIAL_DIAGNOSIS"), "array<array<string>>"), lambda x: F.struct(x[0].alias("name"), x[1].cast("double").alias("prob")))
    out = df.select("_at", F.col("AGE").cast("int").alias("age"), F.col("SEX").alias("sex"), F.col("PATHOLOGY").alias("pathology"), py_list(F.col("EVIDENCES")).alias("evidences"), F.col("INITIAL_EVIDENCE").alias("initial_evidence"), pairs.alias("differential"))
    if severity is not None and level is not None:
        out = out.join(F.broadcast(severity.where(F.col("severity") == level).select("pathology")), "pathology", "left_semi")
    out = out.orderBy("_at").limit(first) if first is not None else out
    return out.withColumnRenamed("_at", "ord")


def explode_evidence(patients: DataFrame) -> DataFrame:
    return patients.select("ord", F.explode("evidences").alias("token")).select("ord", token_base(F.col("token")).alias("base"), token_value(F.col("token")).alias("value"))


def read_coded_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(code, ...) of a JSON object by code whose values have the DDL struct ``value``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("code", "x")).select("code", "x.*")


def read_rrf(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Pipe-delimited rows without a header; a trailing pipe makes one more, empty, field."""
    shape = T.StructType([T.StructField(n, T.StringType()) for n in [*RRF[table], "_end"]])
    return spark.read.csv(path, sep="|", quote="", schema=shape).drop("_end")


def preferred_names(conso: DataFrame, order: str = "ord") -> DataFrame:
    """(cui, name) of English rows: the last preferred one (ts P), else the first."""
    x = conso.where("lat = 'ENG'")
    pref = F.max_by(F.when(F.col("ts") == "P", F.col("str")), F.when(F.col("ts") == "P", F.col(order)))
    return x.groupBy("cui").agg(F.coalesce(pref, F.min_by("str", order)).alias("name"))


def semantic_types(sty: DataFrame) -> DataFrame:
    return sty.groupBy("cui").agg(F.array_sort(F.collect_set("tui")).alias("tuis"))


def relations(rel: DataFrame, nodes: DataFrame, kinds=("SY", "PAR", "CHD", "RB", "RN", "RT"), sabs: list[str] | None = None) -> DataFrame:
    """(x, y, rels): relations of the kinds among the nodes (x), without self pairs, distinct (rel, sab) a pair."""
    r = rel.where(F.col("rel").isin(*kinds) & (F.col("cui1") != F.col("cui2")))
    r = r.where(F.col("sab").isin(*sabs)) if sabs else r
    n = nodes.select("x").distinct()
    r = r.join(n.toDF("cui1"), "cui1", "left_semi").join(n.toDF("cui2"), "cui2", "left_semi")
    return r.groupBy(F.col("cui1").alias("x"), F.col("cui2").alias("y")).agg(F.array_sort(F.collect_set(F.struct("rel", "sab"))).alias("rels"))


EDGE = "disease string, umls_cui string, phenotype string, phenotype_normalized string, hpo_id string, source string, source_id string, section_name string, pmid string, revid string, title string"
SECTION = "disease string, umls_cui string, source string, source_id string, section_name string, section_id string, chapter_title string, pmid string, revid string, title string, topic_title string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str = EDGE) -> DataFrame:
    """JSON lines with optional keys; a line that is no JSON is a row of nulls."""
    return spark.read.schema(schema).json(path)


def wiki_sections(pages: DataFrame, allow: list[str], least: int = 100) -> DataFrame:
    """(page_id, ord, section, text) of '== Heading ==' parts whose heading holds an allowed word and whose text is long enough."""
    parts = pages.select("page_id", F.posexplode(F.split("text", r"(?m)^(?===+[^=\n]+==+\s*$)")).alias("ord", "part"))
    name = F.trim(F.regexp_extract("part", r"^==+([^=\n]+)==+", 1))
    body = F.regexp_replace(F.regexp_replace("part", r"^==+[^=\n]+==+\s*", ""), r"\s+$", "")
    ok = F.lit(False)
    for a in allow:
        ok = ok | F.lower(name).contains(a)
    return parts.select("page_id", "ord", name.alias("section"), body.alias("text")).where(ok & (F.length("text") > least))


def html_sections(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, ord, section, text) of h1 and h2 parts: tags, scripts and styles out, entities decoded, long enough."""
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    parts = pages.select("page_id", F.posexplode(F.split(bare, r"(?i)(?=<h[12][ >])")).alias("ord", "part")).where("ord > 0")
    clean = lambda c: F.trim(F.regexp_replace(unescape_html(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"\s+", " "))
    name = clean(F.regexp_extract("part", r"(?is)^<h[12][^>]*>(.*?)</h[12]>", 1))
    body = clean(F.regexp_replace("part", r"(?is)^<h[12][^>]*>.*?</h[12]>", ""))
    return parts.select("page_id", "ord", name.alias("section"), body.alias("text")).where(F.length("text") >= least)


#: Entities that pages use (fixed values); the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_html(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Weights of the frequency labels (fixed values).
FREQUENCY = {"Obligate": 1.0, "Very frequent": 0.9, "Frequent": 0.55, "Occasional": 0.17, "Very rare": 0.025, "Excluded": 0.0}


def read_disorders(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, finding, term, w) from disorder XML; an unknown frequency weighs 0.5."""
    shape = "OrphaCode string, Name string, HPODisorderAssociationList struct<HPODisorderAssociation: array<struct<HPO: struct<HPOId: string, HPOTerm: string>, HPOFrequency: struct<Name: string>>>>"
    x = spark.read.format("xml").option("rowTag", "Disorder").schema(shape).load(path)
    x = x.select(F.col("OrphaCode").alias("code"), F.col("Name").alias("name"), F.explode("HPODisorderAssociationList.HPODisorderAssociation").alias("a"))
    label = F.regexp_extract("a.HPOFrequency.Name", r"^([A-Za-z ]+?)\s*(?:\(|$)", 1)
    table = F.create_map(*[F.lit(v) for kv in FREQUENCY.items() for v in kv])
    return x.select("code", "name", F.col("a.HPO.HPOId").alias("finding"), F.col("a.HPO.HPOTerm").alias("term"), F.coalesce(F.try_element_at(table, label), F.lit(0.5)).alias("w"))


def read_topics(spark: SparkSession, path: str, first: int = 3, least: int = 100) -> DataFrame:
    """(topic, ord, text) of health-topic XML: the first documents' full summary, else the snippet, long enough."""
    shape = "term string, document array<struct<content: array<struct<_VALUE: string, _name: string>>>>"
    x = spark.read.format("xml").option("rowTag", "nlmSearchResult").schema(shape.replace("document", "list struct<document:").replace("array<struct<content", "array<struct<content", 1) + ">").load(path)
    docs = x.select("term", F.posexplode(F.slice("list.document", 1, first)).alias("ord", "d"))
    of = lambda n: F.get(F.filter("d.content", lambda c: c["_name"] == n), 0)["_VALUE"]
    return docs.select(F.col("term").alias("topic"), "ord", F.coalesce(of("FullSummary"), of("snippet")).alias("text")).where(F.length("text") > least)


def read_brat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stand-off annotations: spans (doc, id, type, start, stop, text), events (doc, id, type, target), relations (doc, id, type, a, b)."""
    x = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ann$", 1).alias("doc"), F.split("value", "\t").alias("f"))
    id_, body, nth = F.col("f")[0], F.split(F.try_element_at("f", F.lit(2)), r"[ ;]"), F.get
    arg = lambda n: nth(F.split(nth(F.filter(body, lambda b: b.startswith(n)), 0), ":"), 1)
    spans = x.where(id_.startswith("T")).select("doc", id_.alias("id"), nth(body, 0).alias("type"), nth(body, 1).try_cast("int").alias("start"), F.try_element_at(body, F.lit(-1)).try_cast("int").alias("stop"), F.try_element_at("f", F.lit(3)).alias("text"))
    events = x.where(id_.startswith("E")).select("doc", id_.alias("id"), nth(F.split(nth(body, 0), ":"), 0).alias("type"), nth(F.split(nth(body, 0), ":"), 1).alias("target"))
    rels = x.where(id_.startswith("R")).select("doc", id_.alias("id"), nth(body, 0).alias("type"), arg("Arg1").alias("a"), arg("Arg2").alias("b"))
    return {"spans": spans, "events": events, "relations": rels}


def modify_pairs(ann: dict[str, DataFrame], source: str) -> DataFrame:
    """(doc, symptom, attribute): MODIFY relations whose target's span has the type; events stand for their spans."""
    named = ann["spans"].select("doc", "id", "type", "text")
    named = named.unionByName(ann["events"].join(named.select("doc", F.col("id").alias("target"), "text"), ["doc", "target"]).select("doc", "id", "type", "text"))
    r = ann["relations"].where("type = 'MODIFY'")
    side = lambda c, t: named.select("doc", F.col("id").alias(c), F.col("text").alias(f"t_{c}"), F.col("type").alias(t))
    x = r.select("doc", "a", "b").join(side("a", "type_a"), ["doc", "a"]).join(side("b", "type_b"), ["doc", "b"])
    return x.where(F.col("type_b") == source).select("doc", F.col("t_b").alias("symptom"), F.col("t_a").alias("attribute"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated disease annotations with # comments: (disease_id, name, hpo, frequency, n_refs)."""
    shape = "database_id string, disease_name string, qualifier string, hpo_id string, reference string, evidence string, onset string, frequency string"
    x = spark.read.csv(path, sep="\t", comment="#", schema=shape).where("qualifier IS NULL OR qualifier <> 'NOT'").where("database_id <> 'database_id'")
    return x.groupBy("database_id", "hpo_id").agg(F.first("disease_name").alias("name"), F.max("frequency").alias("frequency"), F.count_distinct("reference").alias("n_refs"))


def read_manifest(manifest: DataFrame, files: DataFrame, extractors: dict) -> DataFrame:
    """Sections of all manifest rows (path, source, status) with status ok: files (path, text), an extractor by source."""
    ok = manifest.where("status = 'ok'").join(files, "path")
    out = None
    for source, extract in extractors.items():
        part = extract(ok.where(F.col("source") == source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
