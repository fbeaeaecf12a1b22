"""Queries over the file readers: each writes the driver's tables in a source's format to the shared folder and reads them back."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators import reports
from lattiq.plans.bindings import t
from lattiq.plans.queries import query
from lattiq.shared import fresh_path
from lattiq.sources import crawl, readers, stores


def as_text(s, lines: DataFrame, name: str) -> str:
    """The path of a folder of text files with the one column of ``lines``."""
    path = fresh_path(s, name)
    lines.write.text(path)
    return path


def as_file(s, content: bytes, name: str) -> str:
    """The path of a folder with one small file of a given name."""
    path = fresh_path(s, "fixture")
    fs, inside = pafs.FileSystem.from_uri(path)
    fs.create_dir(inside, recursive=True)
    with fs.open_output_stream(f"{inside}/{name}") as f:
        f.write(content)
    return path


PATIENTS = """SELECT c_custkey, c_custkey % 90 AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_mktsegment AS pathology, c_nationkey FROM customer"""


def _patients(s, sf):
    c = t(s, sf, "customer").orderBy("c_custkey")
    n = F.col("c_nationkey").cast("string")
    differential = F.concat(F.lit("[['"), "c_mktsegment", F.lit("', 0.5], ['other', 0.25]]"))
    evidences = F.when(F.col("c_custkey") % 7 == 0, "[]").otherwise(F.concat(F.lit("['E_1', 'E_2_@_V_"), n, F.lit("_@_x']")))
    rows = c.select((F.col("c_custkey") % 90).alias("AGE"), differential.alias("DIFFERENTIAL_DIAGNOSIS"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("SEX"),
                    F.col("c_mktsegment").alias("PATHOLOGY"), evidences.alias("EVIDENCES"), F.concat(F.lit("E_"), F.col("c_custkey").cast("string")).alias("INITIAL_EVIDENCE"))
    path = fresh_path(s, "patients")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query(f"SELECT age, sex, pathology, 'E_' || c_custkey AS initial_evidence, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 2 END AS n, pathology AS first_name, CAST(0.5 AS DOUBLE) AS first_prob FROM ({PATIENTS})")
def patient_rows(s, sf):
    x = readers.read_patients(s, _patients(s, sf))
    return x.select(F.col("age").cast("long").alias("age"), "sex", "pathology", "initial_evidence", F.size("evidences").alias("n"), F.col("differential")[0]["name"].alias("first_name"), F.col("differential")[0]["prob"].alias("first_prob"))


@query(f"SELECT 'E_' || c_custkey AS initial_evidence, age FROM ({PATIENTS}) WHERE pathology IN ('BUILDING', 'MACHINERY') ORDER BY c_custkey LIMIT 40")
def patients_bounded(s, sf):
    level = s.createDataFrame([("BUILDING", 2), ("MACHINERY", 2), ("FURNITURE", 3)], "pathology string, severity int")
    return readers.read_patients(s, _patients(s, sf), level, 2, 40).select("initial_evidence", F.col("age").cast("long").alias("age"))


@query(f"SELECT base, value, count(*) AS n FROM (SELECT 'E_1' AS base, NULL AS value FROM ({PATIENTS}) WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'E_2', 'V_' || c_nationkey || '_@_x' FROM ({PATIENTS}) WHERE c_custkey % 7 <> 0) GROUP BY ALL")
def patient_evidence(s, sf):
    return readers.explode_evidence(readers.read_patients(s, _patients(s, sf))).groupBy("base", "value").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS code, 'Has ' || p_brand || '?' AS question_en, CASE WHEN count(*) % 2 = 0 THEN 'B' END AS data_type FROM part GROUP BY p_brand")
def coded_json(s, sf):
    g = t(s, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    one = F.struct(F.col("p_brand").alias("key"), F.struct(F.concat(F.lit("Has "), "p_brand", F.lit("?")).alias("question_en"), F.when(F.col("n") % 2 == 0, "B").alias("data_type")).alias("value"))
    whole = g.agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value"))
    return readers.read_coded_json(s, as_text(s, whole.coalesce(1), "codes"), "question_en: string, data_type: string")


def _rrf(s, rows: DataFrame, table: str, **fields):
    """Rows as pipe-delimited lines with a trailing pipe; fields not named are empty."""
    empty = F.lit("")
    line = F.concat_ws("|", *[fields.get(n, empty) for n in readers.RRF[table]], empty)
    return readers.read_rrf(s, as_text(s, rows.select(line.alias("value")), table), table)


@query("""WITH c AS (SELECT p_brand AS cui, CASE WHEN p_size % 4 = 0 THEN 'FRE' ELSE 'ENG' END AS lat, CASE WHEN p_size % 3 = 0 THEN 'P' ELSE 'S' END AS ts, p_name || ' "' || p_size || '"' AS str, p_partkey AS ord FROM part)
SELECT cui, coalesce(arg_max(str, ord) FILTER (WHERE ts = 'P'), arg_min(str, ord)) AS name FROM c WHERE lat = 'ENG' GROUP BY cui""")
def rrf_names(s, sf):
    p, size = t(s, sf, "part"), F.col("p_size")
    text = F.concat("p_name", F.lit(' "'), size.cast("string"), F.lit('"'))
    c = _rrf(s, p, "conso", cui=F.col("p_brand"), lat=F.when(size % 4 == 0, "FRE").otherwise("ENG"), ts=F.when(size % 3 == 0, "P").otherwise("S"), aui=F.col("p_partkey").cast("string"), str=text)
    return readers.preferred_names(c.withColumn("ord", F.col("aui").cast("long")))


@query("SELECT p_brand AS cui, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tuis FROM part GROUP BY p_brand")
def rrf_types(s, sf):
    x = readers.semantic_types(_rrf(s, t(s, sf, "part"), "sty", cui=F.col("p_brand"), tui=F.col("p_type")))
    return x.withColumn("tuis", F.array_join("tuis", ","))


@query("""WITH r AS (SELECT DISTINCT p_brand AS x, 'Brand#' || (10 + p_size) AS y, CASE WHEN p_partkey % 3 = 0 THEN 'PAR' WHEN p_partkey % 3 = 1 THEN 'CHD' ELSE 'XX' END AS rel, p_type AS sab FROM part)
SELECT x, y, string_agg(rel || ':' || sab, ',' ORDER BY rel, sab) AS rels FROM r WHERE rel <> 'XX' AND x <> y AND sab IN ('PROMO', 'LARGE') AND y IN (SELECT p_brand FROM part) GROUP BY x, y""")
def rrf_relations(s, sf):
    p = t(s, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "PAR").when(F.col("p_partkey") % 3 == 1, "CHD").otherwise("XX")
    rel = _rrf(s, p, "rel", cui1=F.col("p_brand"), rel=kind, cui2=F.concat(F.lit("Brand#"), (F.col("p_size") + 10).cast("string")), sab=F.col("p_type"))
    x = readers.relations(rel, p.select(F.col("p_brand").alias("x")), sabs=["PROMO", "LARGE"])
    return x.withColumn("rels", F.array_join(F.transform("rels", lambda v: F.concat(v["rel"], F.lit(":"), v["sab"])), ","))


@query("SELECT 'x/A.RRF.gz' AS file, n_nationkey || '|R' || n_regionkey || '|' AS line FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'B.RRF', n_name || '|R3|' FROM nation")
def archived_lines(s, sf):
    import gzip

    rows = [(r.n_nationkey, r.n_regionkey, r.n_name) for r in t(s, sf, "nation").collect()]  # 25 rows
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/A.RRF.gz", gzip.compress("".join(f"{k}|R{g}|\n" for k, g, _ in rows).encode()))
        z.writestr("B.RRF", "".join(f"{n}|R3|\n" for _, _, n in rows))
        z.writestr("C.txt", "1|R1|\n")
    return stores.archive_lines(s, as_file(s, buffer.getvalue(), "a.zip"), ".RRF", 1, ["R1", "R3"])


@query("SELECT CAST(doc_id AS VARCHAR) AS path, lang AS source, CASE WHEN lang = 'en' THEN length(text) ELSE -1 END AS size FROM documents WHERE doc_id % 3 <> 0 AND lang IN ('en', 'de')")
def manifest_sections(s, sf):
    d = t(s, sf, "documents")
    manifest = d.select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("source"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("ok").alias("status"))
    size = {"en": F.length("text"), "de": F.lit(-1)}
    return readers.read_manifest(manifest, d.select(F.col("doc_id").cast("string").alias("path"), "text"), {k: lambda x, c=c: x.select("path", "source", c.cast("long").alias("size")) for k, c in size.items()})


WIKI = "'Lead of ' || n_name || chr(10) || '== Signs and symptoms ==' || chr(10) || repeat('fever ', 20 + n_nationkey % 3) || chr(10) || '== History ==' || chr(10) || 'long ago' || chr(10) || '=== ' || n_name || ' symptoms ===' || chr(10) || repeat('cough ', n_nationkey)"


@query("SELECT n_nationkey AS page_id, 1 AS ord, 'Signs and symptoms' AS section, 6 * (20 + n_nationkey % 3) - 1 AS chars FROM nation UNION ALL SELECT n_nationkey, 3, n_name || ' symptoms', 6 * n_nationkey - 1 FROM nation WHERE 6 * n_nationkey - 1 > 100")
def wiki_headings(s, sf):
    x = t(s, sf, "nation").select(F.col("n_nationkey").alias("page_id"), F.expr(WIKI.replace("chr(10)", "char(10)")).alias("text"))
    return readers.wiki_sections(x, ["symptom"]).select("page_id", "ord", "section", F.length("text").alias("chars"))


def _rooted(rows: DataFrame, line, root: str) -> DataFrame:
    """One XML text of the few rows below a root element."""
    return rows.agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list(line), ""), F.lit(f"</{root}>")).alias("value")).coalesce(1)


LABELS = tuple(readers.FREQUENCY)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, 'HP:' || r_regionkey AS finding, r_name AS term, (CASE (n_nationkey + r_regionkey) % 7 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(readers.FREQUENCY.values())) + " ELSE 0.5 END)::DOUBLE AS w FROM nation, region")
def disorder_xml(s, sf):
    at = (F.col("n_nationkey") + F.col("r_regionkey")) % 7
    label = F.coalesce(F.get(F.array(*[F.lit(f"{x} (99-80%)") for x in LABELS]), at), F.lit("odd"))
    one = F.format_string("<HPODisorderAssociation><HPO><HPOId>HP:%d</HPOId><HPOTerm>%s</HPOTerm></HPO><HPOFrequency><Name>%s</Name></HPOFrequency></HPODisorderAssociation>", "r_regionkey", "r_name", label)
    g = t(s, sf, "nation").crossJoin(F.broadcast(t(s, sf, "region"))).groupBy("n_nationkey", "n_name").agg(F.array_join(F.collect_list(one), "").alias("a"))  # 25 by 5
    line = F.format_string("<Disorder><OrphaCode>%d</OrphaCode><Name>%s</Name><HPODisorderAssociationList>%s</HPODisorderAssociationList></Disorder>", "n_nationkey", "n_name", "a")
    return readers.read_disorders(s, as_text(s, _rooted(g, line, "JDBOR"), "disorders"))


@query("SELECT n_name AS topic, 0 AS ord, 100 + n_nationkey AS chars FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_name, 2, 150 FROM nation")
def topic_xml(s, sf):
    doc = lambda name, n: F.concat(F.lit(f'<document rank="0"><content name="title">T</content><content name="{name}">'), F.repeat(F.lit("s"), n), F.lit("</content></document>"))
    docs = F.concat(doc("FullSummary", F.col("n_nationkey") + 100), doc("snippet", F.lit(50)), doc("snippet", F.lit(150)), doc("FullSummary", F.lit(200)))
    line = F.concat(F.lit("<nlmSearchResult><term>"), "n_name", F.lit("</term><list>"), docs, F.lit("</list></nlmSearchResult>"))
    return readers.read_topics(s, as_text(s, _rooted(t(s, sf, "nation"), line, "all"), "topics")).select("topic", "ord", F.length("text").alias("chars"))


@query("SELECT r_name AS query, CAST(n_nationkey AS VARCHAR) AS pmid, 'On ' || n_name AS title, upper(n_name) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) JOIN region ON r_regionkey = n_regionkey WHERE k <= 3")
def article_search(s, sf):
    s.dataSource.register(crawl.ArticleSource)
    n = t(s, sf, "nation").join(t(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # 25 rows
    found = {}
    for r in n:
        found.setdefault(r.r_name, []).append({"pmid": str(r.n_nationkey), "title": f"On {r.n_name}", "text": r.n_name.upper()})
    return s.read.format("articles").option("queries", json.dumps(sorted(found))).option("fixture", json.dumps(found)).option("retmax", "3").load()


@query("SELECT 'a' AS doc, n_name AS symptom, 'R' || n_regionkey AS attribute FROM nation WHERE n_nationkey % 2 = 0")
def brat_pairs(s, sf):
    lines = []
    for k, (name, g) in enumerate((r.n_name, r.n_regionkey) for r in t(s, sf, "nation").orderBy("n_nationkey").collect()):  # 25 rows
        lines += [f"T{2 * k}\tSign_symptom 0 {len(name)}\t{name}", f"T{2 * k + 1}\tSeverity 0 2\tR{g}", f"E{k}\tSign_symptom:T{2 * k}", f"R{k}\t{'MODIFY' if k % 2 == 0 else 'OTHER'} Arg1:T{2 * k + 1} Arg2:{'E' if k % 4 else 'T'}{k if k % 4 else 2 * k}"]
    return readers.modify_pairs(readers.read_brat(s, as_file(s, "\n".join(lines).encode(), "a.ann")), "Sign_symptom")


@query("SELECT p_brand AS database_id, 'HP:' || p_size AS hpo_id, 'D ' || p_brand AS name, max(CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS frequency, count(DISTINCT p_name) AS n_refs FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_brand, p_size")
def disease_annotations(s, sf):
    cell = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws("\t", "p_brand", F.concat(F.lit("D "), "p_brand"), cell(F.when(F.col("p_partkey") % 5 == 0, "NOT")), F.concat(F.lit("HP:"), F.col("p_size").cast("string")), "p_name", F.lit("TAS"), F.lit(""), cell(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))))
    rows = t(s, sf, "part").select(line.alias("value")).unionByName(s.createDataFrame([("#comment",)], "value string"))
    return readers.read_annotations(s, as_text(s, rows, "annotations"))


@query("SELECT n_nationkey AS \"case\", r_name AS d, n_nationkey + r_regionkey / 10.0 AS score FROM nation, region")
def score_matrix(s, sf):
    names = [r.r_name for r in t(s, sf, "region").orderBy("r_regionkey").collect()]
    buffer = io.BytesIO()
    np.save(buffer, np.arange(25)[:, None] + np.arange(len(names))[None, :] / 10)
    return reports.read_score_matrix(s, s.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary"), names)


@query("SELECT doc_id AS id, length(text) AS chars, CASE WHEN length(text) > 9 THEN 2 ELSE 0 END AS n, CASE WHEN length(text) > 9 THEN CAST(length(text) AS BIGINT) END AS stop FROM documents")
def annotation_round_trip(s, sf):
    n = F.length("text").cast("long")
    one = lambda a, b, label: F.struct(a.alias("start"), b.alias("stop"), F.lit(label).alias("label"))
    labels = F.when(n > 9, F.array(one(F.lit(2).cast("long"), F.lit(5).cast("long"), "sign"), one(F.lit(6).cast("long"), n, "x"))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,label:string>>"))
    items = t(s, sf, "documents").select(F.col("doc_id").alias("id"), "text", labels.alias("labels"))
    back = readers_back(s, stores.annotation_tasks(items))
    return back.select("id", F.length("text").alias("chars"), F.size("labels").alias("n"), F.get("labels", 1)["stop"].alias("stop"))


def readers_back(s, tasks: DataFrame) -> DataFrame:
    return stores.read_tasks(s.read.text(as_text(s, tasks, "tasks")))


#: Part k tells of disease k mod 30, of which 25 are known, and of the finding of its size, of which 40 are known; part k goes to family k mod 9.
FAMILIES = """WITH x AS (SELECT p_partkey AS k, p_partkey % 9 AS f, p_partkey % 30 AS i, p_size AS z, p_partkey % 7 AS r FROM part), y AS (SELECT * FROM x WHERE i < 25 AND z <= 40)
SELECT DISTINCT ['conditions', 'predications', 'relations', 'knowledge base', 'symptom network', 'statements', 'network', 'phenotype graph', 'mapping'][f + 1] AS family, 'C9' || i AS d, 'C1' || (1000 + z) AS p FROM y
WHERE (f <> 1 OR r < 5) AND (f <> 7 OR r > 1) UNION ALL SELECT DISTINCT 'annotations', 'C9' || i, 'C1' || (1000 + z) FROM y WHERE r <> 3"""


def _universe(s):
    """(codes, names, terms, diseases, findings) of the families' fixture: 30 diseases and 50 findings."""
    i, z = s.range(30).select(F.col("id").cast("string").alias("i")), s.range(1, 51).select(F.col("id").cast("string").alias("z"))
    d, p = F.concat(F.lit("C9"), "i"), F.concat(F.lit("C1"), (F.col("z") + 1000).cast("int").cast("string"))
    row = lambda df, scheme, code, c: df.select(F.lit(scheme).alias("scheme"), code.alias("code"), c.alias("concept"))
    codes = row(z, "evidence", F.concat(F.lit("E_"), "z"), p)
    for more in (row(z, "mesh", F.concat(F.lit("D1"), "z"), p), row(i, "mesh", F.concat(F.lit("D9"), "i"), d), row(z, "hpo", F.concat(F.lit("HP:"), F.lpad("z", 7, "0")), p), row(i.where("i % 2 = 0"), "doid", F.concat(F.lit("DOID:"), "i"), d)):
        codes = codes.unionByName(more)
    names = i.select(F.concat(F.lit("Disease no "), "i").alias("name"), d.alias("concept"))
    terms = i.select(F.concat(F.lit("DOID:"), "i").alias("code"), F.concat(F.lit("disease NO "), "i", F.lit(" ")).alias("name"))
    return codes, names, terms, i.where("i < 25").select(d.alias("x")), z.where("z <= 40").select(p.alias("x"))


@query(FAMILIES)
def external_families(s, sf):
    from lattiq.sources import external

    codes, names, terms, diseases, findings = _universe(s)
    k = F.col("p_partkey")
    x = t(s, sf, "part").select(k.alias("k"), (k % 9).alias("f"), (k % 30).cast("string").alias("i"), F.col("p_size").cast("string").alias("z"), (k % 7).alias("r"))
    x = x.withColumns({"d": F.concat(F.lit("C9"), "i"), "p": F.concat(F.lit("C1"), (F.col("z") + 1000).cast("int").cast("string")), "name": F.concat(F.lit("Disease No "), "i")})
    swap = F.col("k") % 2 == 0
    one, two = F.when(swap, F.col("p")).otherwise(F.col("d")), F.when(swap, F.col("d")).otherwise(F.col("p"))
    text = lambda v: F.lit(v)

    def lines(f, line, name, head=None):
        rows = x.where(F.col("f") == f if f is not None else "true").select(line.alias("value"))
        if head:  # a header opens each file, so these small files are one
            rows = s.createDataFrame([(head,)], "value string").unionByName(rows).coalesce(1)
        return as_text(s, rows, name)

    seven = F.when(F.col("r") > 1, "phenotype present").otherwise("phenotype absent")
    sides = [F.when(swap, a).otherwise(b) for a, b in ((text("disease"), text("effect")), (F.col("name"), text("f")), (F.col("i"), F.col("z")), (text("effect"), text("disease")), (text("f"), F.col("name")), (F.col("z"), F.col("i")))]
    own = F.when(F.col("k") % 4 < 2, F.col("d")).otherwise("")
    g = x.where("f = 0").select("name", F.concat(F.lit("E_"), "z").alias("e"), swap.alias("s")).groupBy("name").agg(F.collect_set(F.when(F.col("s"), F.col("e"))).alias("a"), F.collect_set(F.when(~F.col("s"), F.col("e"))).alias("b"))
    obj = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(c, lambda v: F.concat(F.lit('"'), v, F.lit('":{}'))), ","), F.lit("}"))
    conditions = g.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":{"symptoms":'), obj("a"), F.lit(',"antecedents":'), obj("b"), F.lit("}"))), ","), F.lit("}")).alias("value"))  # 30 names
    found = {
        "conditions": external.condition_edges(s, as_text(s, conditions.coalesce(1), "conditions"), names.join(diseases, names.concept == diseases.x, "left_semi"), codes.where(F.col("scheme") == "evidence").join(findings, codes.concept == findings.x, "left_semi")),
        "predications": external.predication_edges(s, lines(1, F.concat_ws(",", text("1"), text("2"), text("3"), F.when(F.col("r") < 5, "CAUSES").otherwise("ISA"), one, text('"a, ""b"""'), text("t"), text("1"), two, text("n"), text("t"), text("1")), "predications"), diseases, findings),
        "relations": external.relation_edges(s, lines(2, F.concat_ws("|", one, text("a"), text("s"), text("RO"), two, *[text("")] * 12), "relations"), diseases, findings),
        "knowledge base": external.knowledge_base_edges(s, lines(3, F.concat(F.lit("UMLS:"), one, F.lit("_x,3,UMLS:"), two, F.lit("_y")), "base"), diseases, findings),
        "symptom network": external.symptom_network_edges(s, lines(4, F.concat_ws("\t", text("a"), text("b"), text("c"), text("d"), F.concat(F.lit("D9"), "i"), F.concat(F.lit("D1"), "z")), "network"), codes, diseases, findings),
        "statements": external.statement_edges(s, lines(5, F.concat_ws(",", own, F.concat(F.lit("D1"), "z"), F.when(own != "", F.col("p")).otherwise(""), F.concat(F.lit("D9"), "i")), "statements", "disease_umls,symptom_mesh,symptom_umls,disease_mesh"), codes, diseases, findings),
        "network": external.network_edges(s, lines(6, F.concat(F.lit("Disease::DOID:"), "i", F.lit("\tDpS\tSymptom::D1"), "z"), "edges"), codes, terms, names, diseases, findings),
        "phenotype graph": external.phenotype_graph_edges(s, lines(7, F.concat_ws(",", seven, *sides), "graph", "display_relation,x_type,x_name,x_id,y_type,y_name,y_id"), codes, names, diseases, findings),
        "mapping": external.mapping_edges(s, lines(8, F.concat_ws("|", "d", text("o"), text("n"), text("h"), "p", text("t"), text("")), "mapping", "#OMIM_CUI|MIM|name|HPO_ID|HPO_CUI|term|"), diseases, findings),
        "annotations": external.annotation_edges(s, lines(None, F.concat_ws("\t", text("OMIM:1"), "name", F.when(F.col("r") == 3, "NOT").otherwise(""), F.concat(F.lit("HP:"), F.lpad("z", 7, "0"))), "annotated", "#comment"), codes, names, diseases, findings),
    }
    out = None
    for family, edges in found.items():
        part = edges.select(F.lit(family).alias("family"), "d", "p")
        out = part if out is None else out.unionByName(part)
    return out


def _articles_xml(rows) -> str:
    parts = "".join(f'<PubmedArticle><PMID>{k}</PMID><ArticleTitle>On <i>{n}</i></ArticleTitle><AbstractText Label="AIM">{n.upper()}</AbstractText><AbstractText>end {g}</AbstractText></PubmedArticle>' for k, n, g in rows)
    return f"<Set>{parts}<PubmedArticle><PMID>0</PMID></PubmedArticle></Set>"


@query("SELECT r_name AS query, CAST(n_nationkey AS VARCHAR) AS pmid, 'On ' || n_name AS title, 'AIM: ' || upper(n_name) || ' end ' || n_regionkey AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def abstract_search(s, sf):
    s.dataSource.register(crawl.AbstractSource)
    rows = t(s, sf, "nation").join(t(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # 25 rows
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r.r_name, []).append((str(r.n_nationkey), r.n_name, r.n_regionkey))
    web = {}
    for name, hits in groups.items():
        web[crawl.address("search", db="pubmed", term=name, retmax="50", sort="relevance", retmode="json")] = json.dumps({"esearchresult": {"idlist": [h[0] for h in hits]}})
        for k in range(0, len(hits), 2):
            web[crawl.address("fetch", db="pubmed", id=",".join(h[0] for h in hits[k : k + 2]), retmode="xml")] = _articles_xml(hits[k : k + 2])
    options = {"queries": json.dumps([*groups, "unknown"]), "search": "search", "fetch": "fetch", "retmax": "50", "batch": "2", "fixture": json.dumps(web)}
    return s.read.format("abstracts").options(**options).load()


@query("""WITH x AS (SELECT n_nationkey AS d, n_name AS term, n_nationkey % 3 AS k FROM nation)
SELECT d, 'topic' AS kind, CASE WHEN k > 0 THEN 'ok' ELSE 'none' END AS status, CASE WHEN k > 0 THEN term END AS title, CASE WHEN k > 0 THEN sha256('<r><document>' || term || '</document></r>') END AS sha256 FROM x
UNION ALL SELECT d, 'encyclopedia', CASE WHEN k <> 1 THEN 'ok' ELSE 'none' END, CASE WHEN k <> 1 THEN upper(term) END, CASE WHEN k <> 1 THEN sha256('{"query": {"pages": {"' || (d + 1) || '": {"pageid": ' || (d + 1) || ', "title": "' || upper(term) || '"}}}}') END FROM x
UNION ALL SELECT d, 'book', 'ok', 'About ' || term || ' ' || i, sha256('<p>NBK' || d || '_' || i || '</p>') FROM x, (SELECT unnest([1, 2]) AS i) WHERE k <= 1 AND length(term) > 4 UNION ALL SELECT d, 'book', 'none', NULL, NULL FROM x WHERE NOT (k <= 1 AND length(term) > 4)""")
def crawled_manifest(s, sf):
    at = {"book": {"search": "bs", "summary": "bm", "page": "bp", "collection": "c"}, "topic": {"search": "ts"}, "encyclopedia": {"search": "es"}}
    n = t(s, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    web = {}
    for d, term in ((r.n_nationkey, r.n_name) for r in n):
        web[crawl.address("ts", db="healthTopics", term=term, retmax=3)] = f"<r><document>{term}</document></r>" if d % 3 else "<r></r>"
        page = {"pageid": d + 1, "title": term.upper()} if d % 3 != 1 else {"missing": ""}
        web[crawl.address("es", action="query", format="json", titles=term, prop="extracts|info|revisions", explaintext=1, rvprop="ids|timestamp", redirects=1)] = json.dumps({"query": {"pages": {str(d + 1): page}}})
        web[crawl.address("bs", db="books", term=f"{term}[title] AND c[book]", retmode="json")] = json.dumps({"esearchresult": {"idlist": [f"{d}1", f"{d}2", f"{d}3", f"{d}4"]}})
        item = lambda i: {"title": f"About {term} {i}" if d % 3 <= 1 and len(term) > 4 else "Other", "chapteraccessionid": f"NBK{d}_{i}"}  # noqa: B023, E731
        web[crawl.address("bm", db="books", id=f"{d}1,{d}2,{d}3,{d}4", retmode="json")] = json.dumps({"result": {f"{d}1": item(1), f"{d}2": item(1), f"{d}3": {"title": "Unlike"}, f"{d}4": item(2)}})
        web |= {f"bp/NBK{d}_{i}/": f"<p>NBK{d}_{i}</p>" for i in (1, 2)}
    targets = t(s, sf, "nation").select(F.col("n_nationkey").alias("d"), F.explode(F.array(*[F.lit(k) for k in at])).alias("kind"), F.col("n_name").alias("term"))
    path = fresh_path(s, "manifest")
    stores.append_new(crawl.crawl_pages(targets.where("d < 9"), at, web.get), path, ["d", "kind", "url"])  # as if it had stopped there
    stores.append_new(crawl.crawl_pages(crawl.pending(targets, s.read.parquet(path)), at, web.get), path, ["d", "kind", "url"])
    return s.read.parquet(path).select("d", "kind", "status", "title", "sha256")


@query("SELECT p_partkey, p_name, p_retailprice AS price, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size FROM part")
def row_store(s, sf):
    import sqlite3
    import tempfile

    rows = t(s, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast("double"), F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).toLocalIterator()
    with tempfile.TemporaryDirectory() as own:  # the driver builds one small file and puts it into the shared folder
        db = sqlite3.connect(f"{own}/db")
        db.execute('CREATE TABLE "an item" (p_partkey INTEGER, p_name TEXT, price REAL, size INTEGER)')
        db.executemany('INSERT INTO "an item" VALUES (?, ?, ?, ?)', rows)
        db.commit(), db.close()
        with open(f"{own}/db", "rb") as f:
            path = as_file(s, f.read(), "items.db") + "/items.db"
    s.dataSource.register(stores.RowStore)
    return s.read.format("row_store").schema("p_partkey bigint, p_name string, price double, size bigint").option("path", path).option("table", "an item").option("partitions", "5").load()


@query("""WITH w AS (SELECT n_name AS d, lower(word) AS word FROM (SELECT n_name, unnest(['the', substr(n_name, 1, 4), 'thing']) AS word FROM nation WHERE n_nationkey < 5) WHERE length(word) >= 4), x AS (SELECT * FROM documents WHERE length(text) > 200),
h AS (SELECT n_name AS d, doc_id, 0 AS stage FROM x JOIN nation ON n_nationkey < 5 AND doc_id % 40 = n_nationkey), k AS (SELECT d, doc_id, 1 AS stage FROM x JOIN w ON regexp_matches(lower(text), '(^|[^\\p{L}])' || word || '([^\\p{L}]|$)')),
g AS (SELECT d, doc_id, min(stage) AS stage FROM (SELECT * FROM h UNION ALL SELECT * FROM k) GROUP BY ALL)
SELECT d, CAST(doc_id AS VARCHAR) AS pmid, stage FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY stage, md5(doc_id || ':42'), CAST(doc_id AS VARCHAR)) AS r FROM g) WHERE r <= 30""")
def abstract_selection(s, sf):
    n = t(s, sf, "nation").where("n_nationkey < 5")
    store = t(s, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.lit(None).cast("string").alias("title"), "text", F.array((F.col("doc_id") % 40).cast("string")).alias("mesh"))
    words = n.select(F.col("n_name").alias("d"), F.explode(F.array(F.lit("the"), F.substring("n_name", 1, 4), F.lit("thing"))).alias("word"))
    return stores.select_abstracts(store, n.select(F.col("n_name").alias("d"), F.col("n_nationkey").cast("string").alias("mesh")), words, 30).select("d", "pmid", "stage")
