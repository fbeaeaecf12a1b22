"""URL filters: host and path rules, else logistic regression on hashed character n-grams.

The model learns from a small labelled URL table: a DataFrame or a list of (url, label), of which at
most ``max_train`` rows are fitted, drawn by a hash of the url. Newton's method works on the distinct
n-grams of that table, hashed into 2^18 buckets. Host and path n-grams hash apart.

Without a table the bundled one serves. It is built by a rule: names of one or two words, unwanted if
one of them is, in many shapes, zones and paths. Words are general ones of the trade (gambling, pills,
loans, adult, piracy, fraud, advertising) and of ordinary sites.

Edge cases: a null url or one without ``://`` has an empty host and path, matches no rule, and gets
the method's verdict (that of the intercept: allow); very long urls are split and scored whole; of
rules of equal length the one that sorts last wins; repeated rows are judged each for itself; extra
columns stay, but one named like a result is replaced; an empty table gives an empty result; rows of
the labelled table with a null count for nothing, and with one class only every url gets that class.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import append_columns

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words of unwanted sites, and words that stand beside them or alone on ordinary ones.
UNWANTED = (
    "casino poker roulette jackpot slots betting bets bingo gambling wager viagra cialis pills pharmacy steroids botox porn xxx sex nude adult "
    "escort webcam cams hentai milf fetish loan loans payday forex crypto-profit replica knockoff warez keygen crack torrent pirated malware phishing "
    "spam trojan spyware scam ads adserver popunder clickbait tracker prizes giveaway sweepstake getrich"
).split()
ORDINARY = (
    "library weather harbour station nation garden theatre history reading orchard motion table thread mother school college museum hospital "
    "travel recipe kitchen music guitar piano football tennis cycling climbing river mountain forest ocean island village city street market "
    "bakery coffee health doctor science physics biology chemistry math python java linux code docs wiki forum news journal times post herald "
    "radio television cinema film photo camera design paint studio gallery books author poetry language grammar dictionary translate "
    "university research institute foundation council parliament government tax law court police army church parish family baby school "
    "pets animal horse bird fish insect flower tree farm tractor engine railway airport bus bicycle car truck repair tools "
    "house building roof window furniture carpet lamp energy solar wind water climate planet space star moon rocket "
    "essex sussex sextant assess classic passage therapist title grape peninsula cocktail mail calendar note search map cloud server data network mobile phone tablet laptop printer software hardware open source git hub"
).split()
BESIDE = "best free online now club zone farm win big top live my the hot shop store world land land24 365 click media link cheap fast easy real login x".split()
ZONES = ("example.com", "example.org", "example.net", "com", "org", "info", "biz", "co.uk", "de", "fr", "io", "site")
STARTS = ("", "www.", "m.", "blog.", "shop.", "news.")
PATHS = ("", "/", "/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}?page=2", "/a/b", "/index.php", "/article/{n}", "/2021/05/{n}.html")


@dataclass(frozen=True)
class UrlParams:
    n: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 18
    l2: float = 0.2
    threshold: float = 0.5
    max_train: int = 4_000


def names() -> list[tuple[str, int]]:
    """(name, label) by rule: each word alone and beside others, on either side, with and without a hyphen."""
    made: dict[str, int] = {}
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, w in enumerate(words):
            made.setdefault(w, label)
            other = ORDINARY[(7 * k + 3) % len(ORDINARY)]
            pairs = [(w, BESIDE[(5 * k + i) % len(BESIDE)]) for i in range(4)] + [(w, other)]
            for i, (a, b) in enumerate(pairs):
                a, b = (a, b) if (i + k) % 2 else (b, a)
                made.setdefault(a + ("-", "", "")[(i + k) % 3] + b, label)
    return list(made.items())


def labelled_urls() -> list[tuple[str, int]]:
    """The bundled table: each name in two zones; start, zone, scheme and path go round, so that these tell nothing."""
    rows = []
    for k, (name, label) in enumerate(names()):
        for i in (0, 5):
            path = PATHS[(3 * k + i) % len(PATHS)].format(n=37 * k + 11 * i)
            rows.append((f"http{'s' * ((i + k) % 2)}://{STARTS[(k + i) % len(STARTS)]}{name}.{ZONES[(k + i) % len(ZONES)]}{path}", label))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def features(host: str, path: str, p: UrlParams) -> list[int]:
    found = set()
    for tag, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        raw = text.encode()
        for n in p.n:
            found.update(zlib.crc32(tag + raw[i : i + n]) % p.buckets for i in range(len(raw) - n + 1))
    return sorted(found)


def drawn(train: DataFrame | list[tuple[str, int]], p: UrlParams) -> list[tuple[str, int]]:
    """The rows (url, label) that are fitted: at most ``max_train``, by a hash of the url."""
    if isinstance(train, DataFrame):
        rows = train.select("url", F.col("label").cast("int").alias("label")).dropna()
        return [(r.url, r.label) for r in rows.orderBy(F.md5("url"), "url", "label").limit(p.max_train).collect()]
    rows = [(u, int(y)) for u, y in train if u is not None and y is not None]
    return sorted(rows, key=lambda r: (zlib.crc32(r[0].encode()), r))[: p.max_train]


def fit(rows: list[tuple[str, int]], p: UrlParams = UrlParams()) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept; the classes weigh alike."""
    weights, y = np.zeros(p.buckets), np.array([v for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        return weights, 50.0 * (2 * y[0] - 1) if len(y) else -50.0
    lists = [features(*split_url(u), p) for u, _ in rows]
    cols = {b: i for i, b in enumerate(sorted({b for x in lists for b in x}))}
    # the weights are x.T @ a (representer theorem), so each Newton step solves in the rows' space, by conjugate gradients
    row, column = np.repeat(np.arange(len(rows)), [len(f) for f in lists]), np.array([cols[b] for f in lists for b in f])
    gram = lambda v: np.bincount(row, np.bincount(column, v[row], len(cols))[column], len(rows)) + v.sum()
    size = np.array([len(f) + 1.0 for f in lists])
    share, f, a = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(len(rows)), np.zeros(len(rows))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        w = np.maximum(share * q * (1 - q), 1e-6)
        a = _solve(lambda v, w=w: gram(v) + p.l2 * v / w, f + share * (y - q) / w, size + p.l2 / w, a)
        if np.abs((after := gram(a)) - f).max() < 1e-3:
            break
        f = after
    weights[list(cols)] = np.bincount(column, a[row], len(cols))
    return weights, float(a.sum())


def _solve(product, target: np.ndarray, diagonal: np.ndarray, x: np.ndarray, most: int = 500) -> np.ndarray:
    """Conjugate gradients from x, preconditioned by the diagonal."""
    r = target - product(x)
    z = r / diagonal
    d, rz, goal = z, r @ z, 1e-10 * max(1e-300, target @ (target / diagonal))
    for _ in range(most):
        if rz <= goal:
            break
        g = product(d)
        step = rz / (d @ g)
        x, r = x + step * d, r - step * g
        z = r / diagonal
        rz, last = r @ z, rz
        d = z + rz / last * d
    return x


def best_rule(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    fits = [(len(h) + len(s), h + s, v) for h, s, v in rules if (host == h or host.endswith("." + h)) and path.startswith(s)]
    return max(fits)[1:] if fits else (None, None)


FIELDS = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")] + [T.StructField("p_block", T.DoubleType())]


def judge_urls(pages: DataFrame, train: DataFrame | list[tuple[str, int]] | None = None, p: UrlParams = UrlParams(), rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's probability of block.

    train: the labelled table, rows (url, label), label 1 for block; without one the bundled table.
    """
    weights, base = fit(drawn(labelled_urls() if train is None else train, p), p)
    at = np.flatnonzero(weights)
    held = pages.sparkSession.sparkContext.broadcast((dict(zip(at.tolist(), weights[at].tolist())), base))

    def run(column: pa.Array) -> list:
        get, rows = held.value[0].get, []
        for url in column.to_pylist():
            host, path = split_url(url)
            rule, verdict = best_rule(host, path, rules)
            score = 1 / (1 + np.exp(-(held.value[1] + sum(get(b, 0.0) for b in features(host, path, p)))))
            rows.append((host, path, rule, verdict or ("block" if score >= p.threshold else "allow"), float(score)))
        cols = list(zip(*rows)) or [[]] * 5
        return [pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(cols[4], pa.float64())]

    return append_columns(pages, "url", run, FIELDS)


def oracle(rules=RULES) -> str:
    """SQL for page_id, host, path and rule of ``pages``."""
    table = ", ".join(f"('{h}', '{s}')" for h, s, _ in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE regexp_replace(substr(url, position('://' IN url) + 3), '[?#][\\s\\S]*$', '') END AS rest FROM pages),
s AS (SELECT page_id, CASE WHEN position('/' IN rest) = 0 THEN rest ELSE substr(rest, 1, position('/' IN rest) - 1) END AS h,
  CASE WHEN position('/' IN rest) = 0 THEN '' ELSE substr(rest, position('/' IN rest)) END AS path FROM u),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
r AS (SELECT * FROM (VALUES {table}) AS t(rh, rp)),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule FROM p LEFT JOIN m USING (page_id)
"""
