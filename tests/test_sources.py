"""Readers, stores and the streaming extension on small files made here."""

import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from lattiq.sources import crawl, readers, stores
from lattiq.streaming import sessions


def test_patients_in_file_order(spark, tmp_path):
    head = "AGE,DIFFERENTIAL_DIAGNOSIS,SEX,PATHOLOGY,EVIDENCES,INITIAL_EVIDENCE\n"
    rows = [f"""{30 + i},"[['Grippe', 0.5], ['Rhume', 0.25]]",M,{'Grippe' if i % 2 else 'Rhume'},"['E_1', 'E_2_@_V_@_3']",E_1\n""" for i in range(6)] + ['40,"[]",F,Grippe,"[]",E_9\n']
    (tmp_path / "p.csv").write_text(head + "".join(rows))
    got = readers.read_patients(spark, str(tmp_path / "p.csv")).collect()
    assert [r.age for r in got] == [30, 31, 32, 33, 34, 35, 40] and got[0].differential[1].prob == 0.25 and got[6].evidences == []
    severity = spark.createDataFrame([("Grippe", 2), ("Rhume", 3)], "pathology string, severity int")
    kept = readers.read_patients(spark, str(tmp_path / "p.csv"), severity, 2, 2)
    assert [r.age for r in kept.orderBy("ord").collect()] == [31, 33]
    assert [(r.base, r.value) for r in readers.explode_evidence(kept.limit(1)).collect()] == [("E_1", None), ("E_2", "V_@_3")]


def test_patients_of_several_files_in_order_of_their_names(spark, tmp_path):
    head = "AGE,DIFFERENTIAL_DIAGNOSIS,SEX,PATHOLOGY,EVIDENCES,INITIAL_EVIDENCE\n"
    for name, ages in (("a", [7]), ("b", range(20, 420)), ("c", [8])):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f'{i},"[]",M,x,"[]",E_1\n' for i in ages))
    assert [r.age for r in readers.read_patients(spark, str(tmp_path), first=3).orderBy("ord").collect()] == [7, 20, 21]
    assert [r.age for r in readers.read_patients(spark, str(tmp_path)).orderBy("ord").collect()] == [7, *range(20, 420), 8]


def test_coded_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"E1": {"question_en": "q?", "data_type": "B"}, "E2": {"question_en": None}}))
    got = {r.code: r.data_type for r in readers.read_coded_json(spark, str(tmp_path / "e.json"), "question_en: string, data_type: string").collect()}
    assert got == {"E1": "B", "E2": None}


def test_rrf(spark, tmp_path):
    def row(cui, ts, name, lat="ENG"):
        f = [""] * 18
        f[0], f[1], f[2], f[14] = cui, lat, ts, name
        return "|".join(f) + "|\n"

    (tmp_path / "c.RRF").write_text(row("C1", "S", 'first "quoted"') + row("C1", "P", "pref 1") + row("C1", "P", "pref 2") + row("C2", "S", "only") + row("C2", "S", "later") + row("C3", "P", "fr", "FRE"))
    df = readers.read_rrf(spark, str(tmp_path / "c.RRF"), "conso").coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    assert {r.cui: r.name for r in readers.preferred_names(df).collect()} == {"C1": "pref 2", "C2": "only"}
    rel = spark.createDataFrame([("A", "CHD", "B", "S"), ("A", "CHD", "B", "S"), ("A", "PAR", "A", "S"), ("A", "XX", "B", "S"), ("A", "RB", "Z", "S")], "cui1 string, rel string, cui2 string, sab string")
    got = readers.relations(rel, spark.createDataFrame([("A",), ("B",)], "x string")).collect()
    assert [(r.x, r.y, [tuple(v) for v in r.rels]) for r in got] == [("A", "B", [("CHD", "S")])]


def test_sections(spark):
    wiki = "Lead.\n== Signs and symptoms ==\n" + "fever " * 30 + "\n== History ==\nlong ago\n=== Symptoms in children ===\n" + "cough " * 30
    got = readers.wiki_sections(spark.createDataFrame([(1, wiki), (2, None)], "page_id long, text string"), ["symptom"]).collect()
    assert [r.section for r in got] == ["Signs and symptoms", "Symptoms in children"] and got[0].text.startswith("fever")
    page = "<html><script>var t='<h2>x</h2>';</script><h1 class='a'>One &amp; two</h1><p>" + "a &lt; b " * 30 + "</p><h2>Short</h2>no"
    got = readers.html_sections(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r.section, r.text[:7]) for r in got] == [("One & two", "a < b a")]


def test_xml_sources(spark, tmp_path):
    item = lambda h, f: f"<HPODisorderAssociation><HPO><HPOId>{h}</HPOId><HPOTerm>t</HPOTerm></HPO><HPOFrequency><Name>{f}</Name></HPOFrequency></HPODisorderAssociation>"
    (tmp_path / "d.xml").write_text(f"<JDBOR><Disorder><OrphaCode>58</OrphaCode><Name>X</Name><HPODisorderAssociationList>{item('HP:1', 'Very frequent (99-80%)')}{item('HP:2', 'odd')}</HPODisorderAssociationList></Disorder></JDBOR>")
    assert sorted((r.finding, r.w) for r in readers.read_disorders(spark, str(tmp_path / "d.xml")).collect()) == [("HP:1", 0.9), ("HP:2", 0.5)]
    doc = lambda n, t: f'<document rank="0"><content name="title">T</content><content name="{n}">{t}</content></document>'
    body = "".join([doc("FullSummary", "s" * 150), doc("snippet", "p" * 120), doc("snippet", "short"), doc("FullSummary", "z" * 200)])
    (tmp_path / "t.xml").write_text(f"<all><nlmSearchResult><term>flu</term><list>{body}</list></nlmSearchResult></all>")
    assert [(r.topic, r.ord, r.text[0]) for r in readers.read_topics(spark, str(tmp_path / "t.xml")).collect()] == [("flu", 0, "s"), ("flu", 1, "p")]


def test_brat(spark, tmp_path):
    (tmp_path / "a.ann").write_text("T1\tSign_symptom 0 5\tfever\nT2\tSeverity 6 12\tsevere\nE1\tSign_symptom:T1\nR1\tMODIFY Arg1:T2 Arg2:E1\nR2\tOTHER Arg1:T2 Arg2:T1\n")
    ann = readers.read_brat(spark, str(tmp_path))
    assert [(r.start, r.stop, r.text) for r in ann["spans"].orderBy("id").collect()] == [(0, 5, "fever"), (6, 12, "severe")]
    assert [(r.doc, r.symptom, r.attribute) for r in readers.modify_pairs(ann, "Sign_symptom").collect()] == [("a", "fever", "severe")]


def test_annotations_and_manifest(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("#c\ndatabase_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\nO:1\tX\t\tHP:1\tr1\t\t\t1/2\nO:1\tX\t\tHP:1\tr2\t\t\t\nO:1\tX\tNOT\tHP:2\tr1\t\t\t\n")
    assert [(r.hpo_id, r.n_refs) for r in readers.read_annotations(spark, str(tmp_path / "h.tsv")).collect()] == [("HP:1", 2)]
    manifest = spark.createDataFrame([("p", "wiki", "ok"), ("q", "wiki", "failed")], "path string, source string, status string")
    files = spark.createDataFrame([("p", "text p"), ("q", "text q")], "path string, text string")
    assert [r.text for r in readers.read_manifest(manifest, files, {"wiki": lambda d: d.select("path", "text")}).collect()] == ["text p"]


def test_stores(spark, tmp_path):
    e = spark.createDataFrame([("d1", "p1", 1.0), ("d1", "p2", 1.0), ("d2", "p1", 2.0)], "d string, p string, w double")
    assert stores.write_graph(e, str(tmp_path / "g")) == {"disease": 2, "finding": 2, "edges": 3}
    path = str(tmp_path / "t")
    assert [stores.append_new(e, path, ["d", "p"]), stores.append_new(e, path, ["d", "p"])] == [3, 0]
    items = spark.createDataFrame([(1, "a fever", [(2, 7, "sign")]), (2, "", [])], "id long, text string, labels array<struct<start:long,stop:long,label:string>>")
    assert sorted(stores.read_tasks(stores.annotation_tasks(items)).collect()) == sorted(items.collect())
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/A.RRF.gz", gzip.compress(b"1|SNOMED|\n2|OTHER|\n"))
        z.writestr("x/B.txt", "3|SNOMED|\n")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    assert [r.line for r in stores.archive_lines(spark, str(tmp_path / "a.zip"), ".RRF", 1, ["SNOMED"]).collect()] == ["1|SNOMED|"]
    art = spark.createDataFrame([(str(i), "has Fever" if i % 2 else "none", []) for i in range(10)], "pmid string, text string, mesh array<string>")
    assert stores.keyword_sample(art, ["fever"], 3).count() == 3


def test_article_source(spark):
    spark.dataSource.register(crawl.ArticleSource)
    fixture = json.dumps({"flu": [{"pmid": "1", "title": "t", "text": "x"}, {"pmid": "2", "title": "t", "text": "y"}]})
    df = spark.read.format("articles").option("queries", json.dumps(["flu", "none"])).option("fixture", fixture).option("retmax", "1").load()
    assert [(r.query, r.pmid) for r in df.collect()] == [("flu", "1")]


def test_streams_equal_batches(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "user_id", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sessions.windowed(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.select(F.col("start").cast("string"), "event_type", "n").collect())
    assert key(spark.table("windows")) == key(sessions.windowed(ev))


def test_dialogue_state(spark, tmp_path):
    shape = "case string, p string, yes boolean"
    for i, rows in enumerate(([("a", "x", True), ("b", "x", False)], [("a", "y", False), ("a", "x", False)])):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    seen = []
    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions.dialogue_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert {r.case: r.asked for r in seen} == {"a": 2, "b": 1}


def test_articles_as_xml_and_broken_answers():
    xml = '<Set><PubmedArticle><PMID>1</PMID><ArticleTitle> A <i>b</i> c</ArticleTitle><AbstractText Label="AIM">x <b>y</b></AbstractText><AbstractText>z</AbstractText></PubmedArticle><PubmedArticle><PMID>2</PMID></PubmedArticle></Set>'
    assert crawl.parse_articles(xml) == [("1", "A b c", "AIM: x y z")]
    assert crawl.parse_articles("<broken") == crawl.parse_articles(None) == []
    assert crawl.parse_ids('{"esearchresult": {"idlist": [1, "2"]}}') == ["1", "2"]
    assert crawl.parse_ids("no json") == crawl.parse_ids("[]") == crawl.parse_ids(None) == []


def test_pages_of_sites_that_fail(spark):
    at = {"book": {"search": "s", "summary": "m", "page": "p", "collection": "c"}, "topic": {"search": "t"}, "encyclopedia": {"search": "e"}}
    targets = spark.createDataFrame([(1, k, "heart") for k in at], "d long, kind string, term string")
    for answer in (None, "", "<x", "{}", "[]"):
        got = crawl.crawl_pages(targets, at, lambda url, a=answer: a).collect()
        assert [(r.status, r.url, r.sha256) for r in got] == [("none", None, None)] * 3
    assert crawl.pending(targets, spark.createDataFrame([(1, "topic")], "d long, kind string")).count() == 2


def test_row_store_with_gaps_and_without_rows(spark, tmp_path):
    import sqlite3

    spark.dataSource.register(stores.RowStore)
    db = sqlite3.connect(tmp_path / "a b.db")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    db.execute("CREATE TABLE none (k INTEGER, v TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(-5, "a"), (0, None), (10**12, "z")])
    db.commit(), db.close()
    read = lambda table: spark.read.format("row_store").schema("k bigint, v string").option("path", str(tmp_path / "a b.db")).option("table", table).load()
    assert sorted(map(tuple, read("t").collect())) == [(-5, "a"), (0, None), (10**12, "z")]
    assert read("none").count() == 0


def test_edges_either_way_round(spark):
    from lattiq.sources import external

    x = lambda *v: spark.createDataFrame([(i,) for i in v], "x string")
    pairs = spark.createDataFrame([("p", "d"), ("d", "q"), ("b", "d"), ("d", "b"), ("p", "p"), ("z", "d"), (None, "d")], "a string, b string")
    got = {tuple(r) for r in external.oriented(pairs, x("d", "b"), x("p", "q", "b")).collect()}
    assert got == {("d", "p"), ("d", "q"), ("d", "b")}
