"""Building weighted evidence edges: merges, co-occurrence, statistics, expansion, clean-up.

Edges are rows (d, p, ...): a disease-like node, a finding-like node, and what is known of the pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import formulas as M
from lattiq.operators.ranges import range_of


def edge_weights(mentions: DataFrame, n_families: int = 5) -> DataFrame:
    """(d, p, freq, n_sources, w) from mentions (d, p, source): ln(1+freq) (0.5 + 0.5 sources/families) idf."""
    pairs = mentions.groupBy("d", "p").agg(F.count("*").alias("freq"), F.count_distinct("source").alias("n_sources"))
    df = pairs.groupBy("p").agg(F.count("*").alias("df"))
    n = pairs.agg(F.count_distinct("d").alias("n_d"))
    weight = F.log1p("freq") * (0.5 + 0.5 * F.col("n_sources") / n_families) * M.IDF["smooth"](F.col("n_d"), F.col("df"))
    return pairs.join(df, "p").crossJoin(F.broadcast(n)).select("d", "p", "freq", "n_sources", weight.alias("w"))


def merge_sources(mentions: DataFrame, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1), families: int = 5) -> DataFrame:
    """One edge a pair from mentions (d, p, source, kind, frequency): sources, provenance, combined score.

    Score: shares of sources, of textbook mentions, of the largest article count, and the frequency.
    """
    prov = F.array_sort(F.collect_list(F.struct("source", "frequency")))
    merged = mentions.groupBy("d", "p").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.count_if(F.col("kind") == "textbook").alias("n_textbook"),
        F.count_if(F.col("kind") == "article").alias("n_article"), F.max("frequency").alias("frequency"), prov.alias("provenance"),
    )
    top = merged.agg(F.greatest(F.max("n_article"), F.lit(1)).alias("top"), F.greatest(F.max("n_textbook"), F.lit(1)).alias("top_book"))
    parts = (F.size("sources") / families, F.col("n_textbook") / F.col("top_book"), F.log1p("n_article") / F.log1p("top"), F.coalesce("frequency", F.lit(0.0)))
    return merged.crossJoin(F.broadcast(top)).withColumn("score", sum(w * x for w, x in zip(weights, parts))).drop("top", "top_book")


def dual_merge(mentions: DataFrame, textbooks: Sequence[str], articles: Sequence[str]) -> DataFrame:
    """(d, p, sources, n_textbook, n_article, textbook_score, article_score, textbook_only, article_only) from mentions (d, p, source).

    The two kinds of source keep scores of their own: the share of textbooks, and the logarithm of the articles'
    mentions over that of the largest; the flags tell pairs that one kind alone has."""
    book, art = F.col("source").isin(*textbooks), F.col("source").isin(*articles)
    x = mentions.where(book | art).groupBy("d", "p").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct(F.when(book, F.col("source"))).alias("n_textbook"), F.count_if(art).alias("n_article"))
    top = x.agg(F.greatest(F.max("n_article"), F.lit(1)).alias("top"))
    flags = {"textbook_only": (F.col("n_textbook") > 0) & (F.col("n_article") == 0), "article_only": (F.col("n_textbook") == 0) & (F.col("n_article") > 0)}
    scores = {"textbook_score": F.col("n_textbook") / len(textbooks), "article_score": F.log1p("n_article") / F.log1p("top")}
    return x.crossJoin(F.broadcast(top)).withColumns(scores | flags).drop("top")


def union_mode(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("d", "p")) -> DataFrame:
    """Old edges stay; of the new ones only pairs not yet there come in."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def selective_union(old: DataFrame, new: DataFrame, least: int) -> DataFrame:
    """As union_mode, for diseases that have fewer than ``least`` findings."""
    rich = old.groupBy("d").agg(F.count_distinct("p").alias("n")).where(F.col("n") >= least).select("d")
    return union_mode(old, new.join(rich, "d", "left_anti"))


def source_sets(edges: DataFrame) -> DataFrame:
    """Set union over sources: (d, p, sources)."""
    return edges.groupBy("d", "p").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def cooccurrence(rows: DataFrame) -> DataFrame:
    """(a, b, n): in how many documents (doc, x) both of an unordered pair occur."""
    x = rows.select("doc", "x").distinct()
    return x.toDF("doc", "a").join(x.toDF("doc", "b"), "doc").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def directed_cooccurrence(rows: DataFrame, anchor: DataFrame) -> DataFrame:
    """(a, b, n) for anchors a and other members b of the same document, and back."""
    x = rows.select("doc", "x").distinct()
    pairs = x.join(anchor.select("x").distinct(), "x", "left_semi").select("doc", F.col("x").alias("a")).join(x.toDF("doc", "b"), "doc").where("a <> b")
    both = pairs.select("doc", "a", "b").union(pairs.select("doc", "b", "a")).toDF("doc", "a", "b").distinct()
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def pair_votes(rows: DataFrame) -> DataFrame:
    """Counts of present / absent / not_related judgements (a, b, doc, verdict), and the polarity."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("present", "absent", "not_related")}
    out = rows.groupBy("a", "b").agg(*[c.alias(f"n_{v}") for v, c in n.items()], F.array_sort(F.collect_set("doc")).alias("docs"))
    polarity = F.when(F.col("n_absent") > F.col("n_present"), "absent").when(F.col("n_present") > 0, "present").otherwise("ambiguous")
    return out.withColumn("polarity", polarity)


def pair_statistics(rows: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Co-occurrence with document counts, Jensen score and signed G2 of every pair of rows (doc, x)."""
    x = rows.select("doc", "x").distinct()
    n = x.agg(F.count_distinct("doc").alias("n_docs"))
    df = x.groupBy("x").agg(F.count("*").alias("k"))
    pairs = cooccurrence(x).join(df.toDF("a", "n_a"), "a").join(df.toDF("b", "n_b"), "b").crossJoin(F.broadcast(n))
    a, b, c = F.col("n"), F.col("n_a") - F.col("n"), F.col("n_b") - F.col("n")
    d = F.greatest(F.col("n_docs") - a - b - c, F.lit(0))
    return pairs.withColumns({"jensen": M.jensen(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("n_docs"), alpha), "g2": M.signed_g2(a, b, c, d)})


def benjamini_hochberg(df: DataFrame, p: str = "p_value", ranges: int = 64) -> DataFrame:
    """``df`` with q: the least of p n / rank over this and all larger p, at most 1.

    Equal p-values share the largest rank, so the order inside ties has no effect and the work is on
    distinct values; these are cut into ranges, ranked by prefix sums over the ranges' counts, so no
    task sorts the whole table.
    """
    values = df.groupBy(p).agg(F.count("*").alias("_n")).where(F.col(p).isNotNull())
    cut = values.withColumn("_r", range_of(values, p, ranges))
    per = cut.groupBy("_r").agg(F.sum("_n").alias("_s"))
    order = Window.orderBy("_r")
    per = per.select("_r", (F.sum("_s").over(order) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_r").orderBy(p)
    ranked = cut.join(F.broadcast(per), "_r").withColumn("_q", F.col(p) * F.col("_all") / (F.col("_before") + F.sum("_n").over(inside)))
    least = ranked.groupBy("_r").agg(F.min("_q").alias("_m"))
    after = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select("_r", F.min("_m").over(after).alias("_later"))
    up = Window.partitionBy("_r").orderBy(F.col(p).desc())
    q = F.least(F.lit(1.0), F.min("_q").over(up), F.coalesce("_later", F.lit(1.0)))
    found = ranked.join(F.broadcast(later), "_r").select(p, q.alias("q"))
    return df.join(found, p, "left")


def pair_filters(pairs: DataFrame, noise: DataFrame, core: DataFrame, k: int = 2) -> DataFrame:
    """Pre-filters of pairs (a, b, n): A n >= k, B no noise member, C both core, D A and B and C, E with k + 1."""
    member = lambda c, t, name: pairs.select(c).distinct().join(t.select(F.col("x").alias(c)).distinct(), c, "left_semi").withColumn(name, F.lit(True))
    out = pairs
    for c in ("a", "b"):
        out = out.join(member(c, noise, f"noise_{c}"), c, "left").join(member(c, core, f"core_{c}"), c, "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    b, cc = ~(no("noise_a") | no("noise_b")), no("core_a") & no("core_b")
    marks = {"f_a": F.col("n") >= k, "f_b": b, "f_c": cc, "f_d": (F.col("n") >= k) & b & cc, "f_e": (F.col("n") >= k + 1) & b & cc}
    return out.select("a", "b", "n", *[v.alias(c) for c, v in marks.items()])


def exclude_related(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Drop (d, p) where p is a synonym or parent of d, or d a parent of p: relations (x, y, rel), y is x's rel."""
    out = mentions
    for rel, x, y in (("SY", "d", "p"), ("PAR", "d", "p"), ("PAR", "p", "d")):
        out = out.join(relations.where(F.col("rel") == rel).select(F.col("x").alias(x), F.col("y").alias(y)).distinct(), ["d", "p"], "left_anti")
    return out


def drop_hubs(edges: DataFrame, most: int) -> DataFrame:
    """Without findings that more than ``most`` diseases share."""
    hubs = edges.groupBy("p").agg(F.count_distinct("d").alias("n")).where(F.col("n") > most)
    return edges.join(hubs, "p", "left_anti")


def category_edges(rows: DataFrame, scale: float = 0.6) -> DataFrame:
    """(d, p, w, category) from rows (d, p, category): scale ln(1+n), the commonest category (ties: the smallest)."""
    n = rows.groupBy("d", "p", "category").agg(F.count("*").alias("n"))
    best = F.min_by("category", F.struct((-F.col("n")).alias("n"), F.col("category")))
    return n.groupBy("d", "p").agg((scale * F.log1p(F.sum("n"))).alias("w"), best.alias("category"))


def allowed(edges: DataFrame, categories: Sequence[str], reportable: DataFrame) -> DataFrame:
    """Edges of allowed categories; those without a category if their finding is reportable (x)."""
    known = reportable.select(F.col("x").alias("p")).distinct().withColumn("_in", F.lit(True))
    ok = F.when(F.col("category").isNull(), F.coalesce("_in", F.lit(False))).otherwise(F.col("category").isin(*categories))
    return edges.join(known, "p", "left").where(ok).drop("_in")


def expand(edges: DataFrame, relations: DataFrame, decay: float = 0.5) -> DataFrame:
    """Add to each edge's disease the findings related to its finding (x, y), decayed; weights of a pair add up."""
    more = edges.join(relations.select(F.col("x").alias("p"), F.col("y").alias("q")).distinct(), "p").select("d", F.col("q").alias("p"), (F.col("w") * decay).alias("w"))
    return edges.select("d", "p", "w").unionByName(more).groupBy("d", "p").agg(F.sum("w").alias("w"))


def two_hops(edges: DataFrame, relations: DataFrame, decays: tuple[float, float] = (0.5, 0.25)) -> DataFrame:
    """Largest weight by which a finding is reached: itself, one hop, two hops."""
    r = relations.select("x", "y").distinct()
    one = edges.join(r, edges.p == r.x).select("d", "y", "w")
    two = one.join(r.toDF("x", "z"), one.y == F.col("x")).select("d", "z", "w")
    every = edges.select("d", "p", "w").union(one.select("d", "y", F.col("w") * decays[0])).union(two.select("d", "z", F.col("w") * decays[1]))
    return every.groupBy("d", "p").agg(F.max("w").alias("w"))


def add_children(edges: DataFrame, children: DataFrame, decay: float = 0.7, most: int = 5) -> DataFrame:
    """Children (p, child) of a finding that the disease lacks, decayed, ``most`` a finding by name."""
    rank = F.row_number().over(Window.partitionBy("d", "p").orderBy("child"))
    more = edges.join(children, "p").withColumn("_n", rank).where(F.col("_n") <= most)
    new = more.groupBy("d", "child").agg((F.max("w") * decay).alias("w")).withColumnRenamed("child", "p")
    return union_mode(edges.select("d", "p", "w"), new)


def copy_aliases(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges of an alias (alias, d) also for the disease it stands for, where that lacks the pair."""
    new = edges.withColumnRenamed("d", "alias").join(alias, "alias").groupBy("d", "p").agg(F.max("w").alias("w"))
    return union_mode(edges.select("d", "p", "w"), new)


def value_shares(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Share of each value among the non-null values of a group."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def aggregate_findings(rows: DataFrame, attribute: str = "value") -> DataFrame:
    """(d, p, n_mentions, dist) from (d, doc, ord, p, value): only a document's first mention of a finding counts.

    Which of several mentions of equal ord is the first is open; a struct as ord can tell all apart."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("d", "doc", "p").orderBy("ord"))).where("_r = 1")
    total = first.groupBy("d", "p").agg(F.count("*").alias("n_mentions"))
    dist = value_shares(first, ["d", "p"], attribute).groupBy("d", "p").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(attribute, "share")))).alias("dist"))
    return total.join(dist, ["d", "p"], "left")


def typed_edges(found: DataFrame, names: DataFrame) -> DataFrame:
    """Names mapped to codes (name, code), rows without code and self loops dropped, parallel edges kept."""
    return found.join(names.select(F.col("name").alias("p"), "code"), "p").where("code <> d").drop("p").withColumnRenamed("code", "p")


def inverse_codes(mapping: DataFrame) -> DataFrame:
    """(code, cui) to (cui, codes)."""
    return mapping.groupBy("cui").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def seed_union(*lists: tuple[str, DataFrame]) -> DataFrame:
    """(x, origins) of the named seed lists (x)."""
    rows = None
    for name, df in lists:
        part = df.select("x", F.lit(name).alias("origin"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("x").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def select_seeds(names: DataFrame, types: DataFrame, sabs: Sequence[str], core: Sequence[str], both: tuple[str, str], rare: Sequence[str]) -> DataFrame:
    """(x, sabs, focused): core type, clinical source; focused if in both named sources, a rare one, or three."""
    semi = types.where(F.col("tui").isin(*core)).select("x").distinct()
    sets = names.where(F.col("sab").isin(*sabs) & ~F.col("suppressed")).join(semi, "x", "left_semi").groupBy("x").agg(F.array_sort(F.collect_set("sab")).alias("sabs"))
    rare_hit = F.arrays_overlap("sabs", F.array(*[F.lit(r) for r in rare])) if rare else F.lit(False)
    two = F.array_contains("sabs", both[0]) & F.array_contains("sabs", both[1])
    return sets.withColumn("focused", two | rare_hit | (F.size("sabs") >= 3))


def cascade_join(left: DataFrame, right: DataFrame, normal: Column, least_name: int = 9, least_key: int = 5, least_ratio: float = 0.5) -> DataFrame:
    """left (name) to right (key, code): exact in lower case, else the name by ``normal``, else the partial match.

    A partial match is one inside the other, for names and keys of a least length; the ratio of their lengths
    must exceed ``least_ratio``, the largest wins, then the smaller key. Of equal keys the smallest code counts."""
    low = lambda c: F.trim(F.lower(c))
    index = right.groupBy(low("key").alias("_k")).agg(F.min("code").alias("code")).where("_k IS NOT NULL")
    names = left.select("name").distinct().select("name", low("name").alias("_low"), normal.alias("_norm"))
    one = names.join(index.toDF("_low", "c1"), "_low", "left").join(index.toDF("_norm", "c2"), "_norm", "left")
    rest = one.where((F.length("_low") >= least_name) & F.col("c1").isNull() & F.col("c2").isNull()).select("name", F.col("_low").alias("_a"))
    pairs = _contained(rest.select("name", "_a"), index.where(F.length("_k") >= least_key), least_ratio)
    three = pairs.groupBy("name").agg(F.min_by("code", F.struct((-F.col("ratio")).alias("r"), F.col("_k"))).alias("c3"))
    out = one.join(three, "name", "left").select("name", F.coalesce("c1", "c2", "c3").alias("code"), F.when(F.col("c1").isNotNull(), "exact").when(F.col("c2").isNotNull(), "normal").when(F.col("c3").isNotNull(), "partial").alias("tier"))
    return left.join(out, "name", "left").select(*left.columns, "code", "tier")


def _contained(names: DataFrame, keys: DataFrame, ratio: float) -> DataFrame:
    """(name, _k, code, ratio) of pairs of names (name, _a) and keys (_k, code) of which one lies in the other and is over ``ratio`` of it.

    The longer text, of n characters, is cut at the multiples of g, a power of two under ratio n / 2. The shorter is
    longer than 2 g, so it holds a whole piece of the longer. It gives all its runs of that length, for each length that
    a longer partner may have (two or three powers of two), so pairs meet on a piece and are then verified."""
    size = lambda n: f"cast(pow(2, floor(log2(greatest(1, ceil({n} * {ratio} / 2) - 1)))) as int)"
    x = names.select(F.struct("name", F.lit(None).cast(keys.schema["code"].dataType).alias("code"), F.lit(True).alias("left")).alias("o"), F.col("_a").alias("s"))
    y = keys.select(F.struct(F.lit(None).cast("string").alias("name"), "code", F.lit(False).alias("left")).alias("o"), F.col("_k").alias("s"))
    every = x.unionByName(y).withColumn("n", F.length("s"))
    grid = every.withColumn("g", F.expr(size("n"))).withColumn("at", F.explode(F.expr("sequence(1, n - g + 1, g)"))).select("o", "s", "n", "g", F.expr("substring(s, at, g)").alias("run"))
    lengths = F.expr(f"array_distinct(transform(sequence(n, cast(ceil(n / {ratio}) as int)), m -> {size('m')}))")
    runs = every.withColumn("g", F.explode(lengths)).where("g <= n").withColumn("at", F.explode(F.expr("sequence(1, n - g + 1)"))).select("o", "s", "n", "g", F.expr("substring(s, at, g)").alias("run")).distinct()
    a, b = grid.alias("a"), runs.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.o.left") != F.col("b.o.left")))
    met = met.where((F.col("a.n") >= F.col("b.n")) & F.col("a.s").contains(F.col("b.s")) & (F.col("b.n") > ratio * F.col("a.n")))
    pick = lambda f: F.when(F.col("a.o.left"), f("a", "b")).otherwise(f("b", "a"))
    return met.select(pick(lambda u, v: F.col(f"{u}.o.name")).alias("name"), pick(lambda u, v: F.col(f"{v}.s")).alias("_k"), pick(lambda u, v: F.col(f"{v}.o.code")).alias("code"), (F.col("b.n") / F.col("a.n")).alias("ratio")).distinct()


def icd_join(left: DataFrame, right: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    """left (x, icd) with code and tier: right (icd, code, ord) by the normalised code, else by what stands before its point.

    Codes are upper case without outer blanks; corrections replace them first; of equal codes the first row of right counts."""
    norm = lambda c: F.upper(F.trim(c))
    index = right.groupBy(norm("icd").alias("_i")).agg(F.min_by("code", "ord").alias("code")).where("_i IS NOT NULL")
    fixed = norm("icd")
    for a, b in (corrections or {}).items():
        fixed = F.when(norm("icd") == a, b).otherwise(fixed)
    x = left.withColumn("_own", fixed).withColumn("_up", F.split("_own", r"\.")[0])
    x = x.join(index.toDF("_own", "c1"), "_own", "left").join(index.toDF("_up", "c2"), "_up", "left")
    return x.select(*left.columns, F.coalesce("c1", "c2").alias("code"), F.when(F.col("c1").isNotNull(), "exact").when(F.col("c2").isNotNull(), "parent").alias("tier"))


def expand_cases(cases: DataFrame, parents: DataFrame, synonyms: DataFrame | None = None, children: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """(case, p) with the findings' parents up to ``depth`` levels, and the synonyms (and children) of all of these levels.

    parents, synonyms, children: rows (x, y). Synonyms of findings at the last level reached count too, but are
    not expanded themselves; children are those of the levels below the last."""
    out = front = cases.select("case", "p").distinct()
    for _ in range(depth):
        up = front.join(parents.toDF("p", "y"), "p").select("case", F.col("y").alias("p")).distinct()
        new = up.join(out, ["case", "p"], "left_anti")
        more = new
        if synonyms is not None:
            more = more.unionByName(front.unionByName(new).join(synonyms.toDF("p", "y"), "p").select("case", F.col("y").alias("p")))
        if children is not None:
            more = more.unionByName(front.join(children.toDF("p", "y"), "p").select("case", F.col("y").alias("p")))
        out, front = out.unionByName(more).distinct(), new
    return out
