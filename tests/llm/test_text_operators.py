"""Decontamination, mixing, token counts, chats, URL rules, licences: brute force, round trips, edges."""

import hashlib
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest

from lattiq.llm import chat, decontam, licenses, mixing, queries, tokencount, urlfilter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string, N_HIT long, size string"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_judge(text, bench):
    words, hit, items, longest = WORD.findall(lower(text)), set(), set(), 0
    for name, item in bench:
        w = WORD.findall(lower(item))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    items.add(name)
                    k = n
                    while i + k < len(w) and j + k < len(words) and w[i + k] == words[j + k]:
                        k += 1
                    longest = max(longest, k)
    return len(words), len(hit), ",".join(sorted(items)), longest


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "dog", "Cat", "9"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, make(n)) for i, n in enumerate((1, 2, 3, 5, 12, 13, 14, 30, 40))] + [(10, None), (11, ""), (12, "...")]
    bench = [(i, t if i else "dog") for i, t in bench] + [(20, bench[6][1]), (None, "a b")]
    docs = [make(rng.randrange(60)) for _ in range(30)] + [f"{make(9)} {bench[k][1]} {make(8)}" for k in (4, 5, 6, 7, 8)] + [bench[7][1] + "," + bench[8][1], None, "", "?!", bench[8][1]]
    rows = [(i % 30, t, "s", 7, "x") for i, t in enumerate(docs)]
    got = decontam.judge(spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame(bench, "item_id long, text string"))
    assert {"source", "size"} <= set(got.columns) and "N_HIT" not in got.columns
    named = [(str(i), t or "") for i, t in bench if i is not None]
    for r, text in zip(got.collect(), docs):
        n, hit, items, longest = plain_judge(text, named)
        assert (r.n_words, r.n_hit, r.longest) == (n, hit, longest)
        assert r.n_items == len([x for x in items.split(",") if x]) and r.items_sha256 == hashlib.sha256(items.encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        if r.longest_item is not None:
            words = WORD.findall(lower(text))[r.longest_at : r.longest_at + r.longest]
            assert " ".join(words) in " ".join(WORD.findall(lower(dict(named)[r.longest_item])))


def test_decontamination_gives_the_spans_of_hit_words(spark):
    item = [f"w{i}" for i in range(30)]
    texts = [["x"] * 3 + item[:14] + ["y"] + item[10:30], item[:13] + item[5:18], ["x"], [], item[2:14]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[3:20])), (2, "y")], "item_id long, text string")
    for p in (decontam.DecontamParams(), decontam.DecontamParams(block_bytes=40)):
        got = {r.doc_id: r for r in decontam.judge(docs, bench, p).collect()}
        assert {i: [tuple(x) for x in r.spans] for i, r in got.items()} == {0: [(3, 38)], 1: [(0, 26)], 2: [], 3: [], 4: []}
        assert all(r.n_hit == sum(x.b - x.a for x in r.spans) for r in got.values())


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "s", 1, "")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontam.judge(docs, bench).collect()] == [(2, False)]
    assert decontam.judge(docs.limit(0), bench).count() == 0


def test_a_large_benchmark_is_judged_in_blocks(spark, tmp_path):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice(["a", "b", "É", "dog", "9"]) for _ in range(n))
    bench = spark.createDataFrame([(i, make(rng.choice((3, 14, 20, 30)))) for i in range(25)], "item_id long, text string")
    texts = [make(rng.randrange(80)) for _ in range(40)] + [r.text for r in bench.collect()] + [None, ""]
    spark.createDataFrame([(i % 30, t, "s", 7, "x") for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    whole, cut = (decontam.judge(docs, bench, decontam.DecontamParams(block_bytes=n)) for n in (1 << 20, 200))
    assert whole.columns == cut.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7)], "doc_id long, text string, __row int, row int, ROW_ int")
    bench = spark.createDataFrame([(0, "a b"), (1, "c d e f g h")], "item_id long, text string")
    for n in (1 << 20, 3):
        got = decontam.judge(docs, bench, decontam.DecontamParams(block_bytes=n)).first()
        assert (got["__row"], got["row"], got["ROW_"], got.n_hit, got.longest_item) == (5, 6, 7, 2, "0")


def test_many_equal_items_are_searched_once(spark):
    names = sorted(str(i) for i in range(3000))
    bench = decontam.Benchmark([(n, b"word") for n in names] + [("x", b"a word"), ("y", b"b b")], decontam.DecontamParams())
    assert len(bench.at) == 3 and len(bench.suffixes) == 5
    got = decontam.scan_shard([b"word " * 4000, b"a word", b"b b b"], bench)
    assert [(r["n_hit"], len(r["items"]), r["longest"], r["longest_item"], r["longest_at"]) for r in got] == [(4000, 3000, 1, "0", 0), (2, 3001, 2, "x", 0), (3, 1, 2, "y", 0)]


def test_the_longest_match_names_the_smallest_item_first(spark):
    rng = random.Random(21)
    make = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    bench = [(str(i), make(rng.randrange(1, 30))) for i in range(40)]
    held = decontam.Benchmark([(n, t.encode()) for n, t in bench], decontam.DecontamParams(window=5))
    for text in [make(rng.randrange(60)) for _ in range(40)]:
        words, best = text.split(), (0,)
        for name, item in bench:
            w = item.split()
            for i in range(len(w)):
                for j in range(len(words)):
                    k = 0
                    while i + k < len(w) and j + k < len(words) and w[i + k] == words[j + k]:
                        k += 1
                    if k >= min(5, len(w)) and (best == (0,) or (-k, name, j) < best):
                        best = (-k, name, j)
        got = decontam.scan_shard([text.encode()], held)[0]
        assert (got["longest"], got["longest_item"], got["longest_at"]) == ((-best[0], *best[1:]) if len(best) > 1 else (0, None, None))


def test_mixing_meets_every_budget(spark):
    rng = random.Random(6)
    sources = ["a"] * 300 + ["b"] * 20 + ["c"] * 60 + [None] * 9 + [""] * 3 + ["é"] * 5
    rows = [(i if i % 7 else 7, " ".join("w" * rng.randrange(40)), s, 0, "x") for i, s in enumerate(sources)] + [(900, None, "z", 0, ""), (901, " \t", "z", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, mixing.MixParams(range_bits=2)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert rs[0].source_size == sum(r["size"] for r in rs)
        assert sum(r.taken for r in rs) == int(rs[0].target)
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6
    again = mixing.mix(docs.repartition(5), mixing.MixParams()).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_the_mixture_holds_the_words_taken(spark):
    rng = random.Random(11)
    gap = lambda: rng.choice([" ", "  ", "\n", "\t "])
    make = lambda n: "".join(gap() * rng.randrange(2) + f"wé{rng.randrange(99)}" + gap() for _ in range(n))
    sources = ["a"] * 90 + ["b"] * 11 + ["c"] * 30 + [None] * 9 + [""] * 3
    rows = [(i if i % 7 else 7, make(rng.randrange(30)), s, 0, "x") for i, s in enumerate(sources)] + [(900, None, "z", 0, ""), (901, " \t", "z", 0, ""), (None, make(2500), "b", 0, "")]
    docs, p = spark.createDataFrame(rows, DOCS).repartition(3), mixing.MixParams(range_bits=2)
    got = mixing.with_mixture(docs, p).collect()
    digest = lambda r: str([r[c] for c in mixing.DIGEST])
    assert sorted(map(digest, got)) == sorted(map(digest, mixing.mix(docs, p).collect()))
    words, texts, cut = (lambda t: re.findall(r"[^ \t-\r]+", t)), {(i, s, t) for i, t, s, _, _ in rows}, 0
    for r in got:
        assert sum(len(words(m.text)) for m in r.mixture) == r.taken
        assert [m.epoch for m in r.mixture] == list(range(1, len(r.mixture) + 1)) and len(r.mixture) == (-(-r.taken // r["size"]) if r["size"] else 0)
        for m in r.mixture[:-1]:
            assert (r.doc_id, r.source, m.text) in texts
        if r.mixture and (r.doc_id, r.source, r.mixture[-1].text) not in texts:
            cut += 1
            assert r.taken % r["size"] and any((i, s) == (r.doc_id, r.source) and t.startswith(r.mixture[-1].text) for i, s, t in texts if t)
    assert 0 < cut <= 4 and any(not r.mixture for r in got) and any(len(r.mixture) == 2 for r in got)
    flat = mixing.mixture(docs, p)
    assert flat.columns == ["doc_id", "source", "epoch", "text"] and flat.count() == sum(len(r.mixture) for r in got)
    assert mixing.mixture(docs.limit(0), p).count() == 0


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([1000, 0, 1]) == [1499.5, 0.0, 2.0]
    assert mixing.targets([]) == []


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_token_files_against_a_plain_scan(spark, tmp_path, block):
    rng, eod = random.Random(7), 9
    files = {"a": [[1] * rng.randrange(9) for _ in range(40)], "b": [[]] * 5, "c": [[2] * 30], "d": []}
    open_end = {"a": [3, 3], "b": [], "c": [], "d": [4] * 11}
    for name, docs in files.items():
        flat = [x for d in docs for x in [*d, eod]] + open_end[name]
        (tmp_path / f"{name}.bin").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = tokencount.token_counts(spark, str(tmp_path), tokencount.TokenFileParams(eod=eod, block_tokens=block, group=3)).collect()
    for name, docs in files.items():
        want, at = [], 0
        for d in docs + ([open_end[name]] if open_end[name] else []):
            want.append((len(want), len(d), at))
            at += len(d) + 1
        assert sorted((r.doc_ord, r.n_tokens, r.start) for r in got if r.path.endswith(f"/{name}.bin")) == want
    assert not [r for r in got if "empty" in r.path]


def test_token_counts_of_documents(spark):
    texts = ["hello world", None, "", "é" * 50, "<|endoftext|>", "a\nb"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "s", 0, "") for i, t in enumerate(texts)], DOCS)
    enc = tokencount.load_encoding(queries.VOCABULARY)
    got = sorted((r.n_tokens, str(r.doc_id)) for r in tokencount.count_documents(docs, queries.VOCABULARY).collect())
    assert got == sorted((len(enc.encode_ordinary(t or "")), str(i if i != 3 else None)) for i, t in enumerate(texts))


def test_files_that_no_row_names_do_not_count(spark, tmp_path):
    texts = [["a b", "", None, "a b c d"][i % 4] for i in range(50)]
    docs = spark.createDataFrame([(i // 2, t, "s", 0, "") for i, t in enumerate(texts)], DOCS).repartition(3)
    small = tokencount.TokenFileParams(block_tokens=4)
    written = tokencount.write_token_files(docs, f"file://{tmp_path}/t", queries.VOCABULARY, small)
    (tmp_path / "t" / "leftover").write_bytes(b"\1\0" * 33)  # of an attempt that was lost
    assert written.select("file").distinct().count() == 3
    got = tokencount.named_counts(written, tokencount.token_counts(spark, f"file://{tmp_path}/t", small))
    enc = tokencount.load_encoding(queries.VOCABULARY)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i // 2, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    assert tokencount.count_documents(docs.limit(0), queries.VOCABULARY).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", ">", "\\", "/", "s", "[", "INST]", "é", "\n", *chat.CONTROL]) for _ in range(rng.randrange(10)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROL)


def test_chats_with_all_part_types(spark):
    shape = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:long>>"
    rows = [
        (1, 1, "assistant", [("text", "<|end|>\\", None, None), ("image", None, "i.png", 4), ("text", "!", None, None)]),
        (1, 0, "user", [("audio", None, "a.wav", 10), ("document", None, "d.pdf", None), ("text", None, None, None)]),
        (2, 0, None, None),
    ]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, shape)).collect()}
    turns, learnt = chat.read_back(out[1].formatted, [(s.start, s.stop) for s in out[1].loss])
    assert turns == [("user", "<|audio:0|><|document:1|>"), ("assistant", "<|end|>\\<|image:2|>!")] and learnt == turns[1][1]
    assert [(a.ord, a.type, a.ref, a.tokens) for a in out[1].attachments] == [(0, "audio", "a.wav", 250), (1, "document", "d.pdf", 512), (2, "image", "i.png", 1024)]
    assert all(out[1].formatted[a.at :].startswith(f"<|{a.type}:{a.ord}|>") for a in out[1].attachments)
    assert chat.read_back(out[2].formatted, []) == ([("", "")], "")
    with pytest.raises(ValueError):
        chat.PartVisitor().visit({"type": "video"})
    assert chat.digests(chat.format_chats(spark.createDataFrame([], shape))).count() == 0


def test_url_rules(spark):
    cases = {
        "http://A.Net/x?y": ("a.net", "/x", "net/", "block"), "https://www.EXAMPLE.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "x://notexample.com/de/a": ("notexample.com", "/de/a", None, None),
        "http://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"), "http://a.net": ("a.net", "", None, None), "http://a.net?/x": ("a.net", "", None, None),
        "a.net/x": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "http://x.net/a://b.org/fr/": ("x.net", "/a://b.org/fr/", "net/", "block"),
    }
    rows = spark.createDataFrame([(i, u, "h", "old") for i, u in enumerate(cases)], "page_id long, url string, html string, HOST string")
    for r, (host, path, rule, verdict) in zip(urlfilter.judge_urls(rows).collect(), cases.values()):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.html == "h"
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urlfilter.judge_urls(rows.limit(0)).count() == 0


def _judge(rows):
    weights, base = urlfilter.fit(urlfilter.drawn(rows, urlfilter.UrlParams()))
    return lambda url: sum(weights[b] for b in urlfilter.features(*urlfilter.split_url(url), urlfilter.UrlParams())) + base > 0


def test_url_model_on_held_out_names():
    rows = urlfilter.labelled_urls()
    host = lambda u: urlfilter.split_url(u)[0]
    held = {n for n, _ in urlfilter.names() if zlib.crc32(n.encode()) % 4 == 0}
    test = [(u, y) for u, y in rows if any(part in held for part in host(u).split("."))]
    blocks = _judge(sorted(set(rows) - set(test)))
    caught, taken, bad = sum(blocks(u) for u, y in test if y), sum(blocks(u) for u, y in test if not y), sum(y for _, y in test)
    assert caught / bad > 0.85 and caught / (caught + taken) > 0.95 and 100 < bad < len(test) - 100


def test_url_model_on_names_of_other_making():
    blocks = _judge(urlfilter.labelled_urls())
    bad = "poker-online.example.com malware.example.com phishing-login.ru pornhub.com viagra-shop.biz sexycams.io onlinecasinos24.com quickloans.co.uk"
    fine = "github.com/a/b www.nytimes.com/2020/a.html en.wikipedia.org/wiki/Cat stackoverflow.com/questions/1 docs.python.org/3/ www.bbc.co.uk/news therapy.example.com arxiv.org/abs/1"
    assert [u for u in bad.split() if not blocks(f"http://{u}")] == [] and [u for u in fine.split() if blocks(f"https://{u}")] == []


def test_url_model_learns_from_a_table(spark):
    train = spark.createDataFrame([(f"http://{'vile' if i % 2 else 'good'}{i}.example.com/", i % 2) for i in range(60)] + [(None, 1), ("http://x.y/", None)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://vile.example.com/"), (2, "http://goods.example.com/"), (2, "http://goods.example.com/"), (3, None), (4, "http://" + "vile" * 5000)], "page_id long, url string")
    got = [r.verdict for r in urlfilter.judge_urls(pages, train).collect()]
    assert got[:3] == ["block", "allow", "allow"] and got[4] == "block"
    one = [r.verdict for r in urlfilter.judge_urls(pages, train.where("label = 1")).collect()]
    none = [r.verdict for r in urlfilter.judge_urls(pages, train.limit(0)).collect()]
    assert set(one) == {"block"} and set(none) == {"allow"}
    assert len(urlfilter.drawn(train, urlfilter.UrlParams(max_train=7))) == 7


def test_licences(spark):
    mit = licenses.SENTENCES
    whole = f"Intro.\n{mit['mit_grant']}\n{mit['mit_include']} {mit['mit_as_is']}\nEnd"
    cases = [whole, "Text. released  under the MIT license.\nAll Rights Reserved.", "All rights are reserved.", None, "", mit["mit_include"], "x Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    docs = spark.createDataFrame([(i, t, "s", 0, "") for i, t in enumerate(cases)], DOCS)
    got = licenses.scan_licenses(docs).collect()
    assert [r.licences for r in got] == ["MIT", "MIT,proprietary", "", "", "", "", "", "CC-BY-NC-4.0"]
    assert got[0].n_matches == 1 and whole[got[0].spans[0].start : got[0].spans[0].stop].startswith("Permission is hereby")
    wide = licenses.LicenseParams(max_gap=1)
    gap = f"{mit['gpl_free']} Other words.\n{mit['gpl_hope']}"
    scan = lambda p: licenses.Scanner(p=p).scan(gap)
    assert not scan(licenses.LicenseParams()) and [x[0] for x in scan(wide)] == ["GPL-3.0-or-later"]


def test_the_licence_sql_holds_rules_of_several_sentences(spark):
    known, rng = licenses.SENTENCES, random.Random(17)
    texts = ["\n".join(known[n] for n in names) for _, names in licenses.RULES]
    pool = [*known.values(), "Other words.", "1.", "*"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(300)] + [" ".join(known[n] for n in rng.choice(licenses.RULES)[1]) for _ in range(40)]
    texts += ["1. " + known["bsd_grant"] + "\n1. " + known["bsd_source"] + "\n2. " + known["bsd_binary"] + "\n3. " + known["bsd_name"], None, "", "x " * 50_000 + ". All rights reserved."]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(c.execute(licenses.oracle()).fetchall())
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = licenses.scan_licenses(docs)
    assert sorted({tuple(r) for r in got.select("doc_id", "n_matches", "licences").collect()}) == want
    assert [got.where(f"doc_id = {i}").first().licences for i in range(len(licenses.RULES))] == [r[0] for r in licenses.RULES]
    assert got.where("doc_id = 0").count() == 2 and licenses.scan_licenses(docs.limit(0)).count() == 0
    assert want[-4][2] == "BSD-3-Clause" and want[-1][2] == "proprietary"


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "; ", "    "])
@pytest.mark.parametrize("width", [40, 72])
def test_licences_of_wrapped_texts(prefix, width):
    known = licenses.SENTENCES

    def wrapped(*paragraphs):
        lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width), ""]]
        return "\n".join((prefix + x).rstrip() for x in lines)

    mit = wrapped("The MIT License", "Copyright (c) 2020 Some Body", known["mit_grant"], known["mit_include"], known["mit_as_is"] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE.")
    gpl = wrapped("A program.", f"{known['gpl_free']} {known['gpl_hope']} See the licence for more.")
    apache = wrapped(f"{known['apache_named']} {known['apache_comply']} {known['apache_obtain']}", "http://www.apache.org/licenses/LICENSE-2.0")
    url = apache.replace(f"\n{prefix.rstrip()}\n{prefix}http", f"\n{prefix}http")
    for text, licence, first in ((mit, "MIT", "Permission"), (gpl, "GPL-3.0-or-later", "This program"), (apache, "Apache-2.0", "Licensed"), (url, "Apache-2.0", "Licensed")):
        got = licenses.Scanner().scan(f"import x\n{text}\n\ncode()")
        assert [x[0] for x in got] == [licence]
        assert f"import x\n{text}"[got[0][1] :].startswith(first)
    headed = wrapped("Copyright (c) 2020 Some Body") + "\n" + mit[mit.index("Permission") - len(prefix) :]
    assert [x[0] for x in licenses.Scanner().scan(headed.replace(f"Body\n{prefix.rstrip()}\n", "Body\n"))] == ["MIT"]


def test_unwrapped_texts_keep_their_places():
    rng = random.Random(13)
    for _ in range(2000):
        text = "".join(rng.choice(["\n", "\n", " ", "# ", "/*", "*/", "a", "Be.", "http://x", "\r\n", "é"]) for _ in range(rng.randrange(14)))
        flat = licenses.unwrap(text)
        assert len(flat) == len(text) and all(f in (c, " ") for f, c in zip(flat, text))
    assert licenses.unwrap("one\ntwo.\n\n# x\n#\n# y") == "one two.\n\n  x\n \n  y"


def test_mixing_counts_off_rows_alike(spark):
    """A hot id, a hot text and repeated rows: the cut falls among rows of equal id and size."""
    rows = [(7, "w " * 5, "a", 0, "x")] * 300 + [(7, f"{i} " * 5, "a", 0, "x") for i in range(100)] + [(i, "w w w", "b", 0, "x") for i in range(10)] + [(None, "x " * 3, "c", 0, "")] * 50
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for got in (mixing.mix(docs).collect(), mixing.with_mixture(docs).collect()):
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
        for source in "abc":
            mine = [r for r in got if r.source == source]
            assert sum(r.taken for r in mine) == int(mine[0].target)
    assert all(sum(len(m.text.split()) for m in r.mixture) == r.taken for r in mixing.with_mixture(docs).collect())


def test_mixing_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a", 0, ""), (2, "b c", "b", 0, "")], DOCS)
    got = {r.doc_id: r for r in mixing.with_mixture(docs).collect()}
    assert got[1]["size"] == 300_000 and sum(len(m.text.split()) for m in got[1].mixture) == got[1].taken == int(got[1].target)


def test_chats_with_repeats_nulls_and_other_columns(spark):
    shape = "conv_id long, turn long, role string, text string, parts string, formatted string"
    rows = [(1, None, "user", "late", "p", "f"), (1, 0, "user", "a", "p", "f"), (1, 0, "user", "a", "p", "f"), (None, 0, "assistant", "x" * 100_000, "p", "f"), (None, 1, None, None, "p", "f")]
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.text_parts(spark.createDataFrame(rows, shape)))).collect()}
    assert (out[1].n_turns, out[1].loss_chars) == (3, 0) and (out[None].n_turns, out[None].loss_chars) == (2, 100_000)
    assert out[1].turns_sha256 == hashlib.sha256(b"user\nlate\nuser\na\nuser\na\n").hexdigest()
    assert out[None].loss_sha256 == hashlib.sha256(b"x" * 100_000).hexdigest()
