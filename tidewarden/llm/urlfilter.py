"""URL filters: site rules first, then gradient-boosted trees on lexical features.

Everything on the main path is DataFrame expressions.  The trees are small and are
fitted on the driver from labelled URLs (``fit`` takes a bounded sample of a table of
them), then written out as one SQL expression for Spark and one for DuckDB.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict) of the site rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Words from which the labelled URLs are composed, common ones of either kind.  Both
# lists have hosts with and without hyphens and digits; none is taken from a table.
BLOCKED_NAMES = ("pharmadirect", "jackpot-city", "wager24", "loanshark", "popunder-media", "cashprize", "quick-credit-4u", "dealblast", "click-bait", "pokerstream", "slots-99-bonus", "buyfollowers", "replicawatch", "miracle-diet", "cryptodouble", "instantcredit", "sweepstake7", "dating-tonight")
ALLOWED_NAMES = ("news", "open-library", "museum", "saint-james-school", "gazette", "city-hospital", "university", "weather", "new-town-council", "science", "radio4", "archive", "choir-of-the-valley", "handbook", "observatory", "rail-timetable", "gardening", "channel9")
#: Raw score (log odds) above which the trees block: a probability of 0.8, as most URLs are fine.
BLOCK_ABOVE = round(math.log(0.8 / 0.2), 6)
BLOCKED_SUFFIXES, ALLOWED_SUFFIXES = ("top", "info", "com", "biz", "net"), ("org", "com", "edu", "net", "info")
TOPICS = ("history", "opening-hours", "annual-report", "weather-in-the-north", "contact", "how-to-read-a-map", "minutes")


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled URLs: (url, 1 to block or 0 to allow), composed from the words above.

    No single feature separates the classes: each has long and short URLs, deep and flat
    paths, parameters, digits, hyphens and the suffixes com, net and info.
    """
    blocked, allowed = [], []
    for i, (bad, good) in enumerate(zip(BLOCKED_NAMES, ALLOWED_NAMES, strict=True)):
        for j in range(6):
            n = 7919 * (i + 1) + 104729 * (j + 1)
            code = "".join("abcdefghijklmnopqrstuvwxyz0123456789"[n * (k + 3) ** 3 % 36] for k in range(8 + n % 9))
            topic, other = TOPICS[(i + j) % 7], TOPICS[(i + 3 * j + 2) % 7]
            host = f"{('', 'www.', 'm.', 'secure.login.', '')[(i + j) % 5]}{bad}{('', n % 90, '')[(i + 2 * j) % 3]}.{BLOCKED_SUFFIXES[(2 * i + j) % 5]}"
            tail = (f"go/{code}?id={n}&aff={j}&u={code}", "order/now?ref=mail&aff=partner&sid=summer", f"?ref={code}", f"a/b/c/{code}.php?x={n}", "win", f"{topic}?from=mail&to=offer&step=one")[(i + j) % 6]
            blocked.append((f"http{'s' * ((i + j) % 2)}://{host}/{tail}", 1))
            host = f"{('www.', '', 'blog.', 'www.', 'data.archive.')[(i + j) % 5]}{good}.{ALLOWED_SUFFIXES[(2 * i + j) % 5]}"
            tail = (topic, f"{2001 + n % 20}/{n % 12 + 1:02d}/{n % 28 + 1:02d}/{n}.html?utm_source=mail", f"{topic}/{other}?utm_source=feed&utm_medium=web", f"search?q={topic}&page={j + 1}", f"records/{n * 31}/{n % 1000}?page={j}&sort=date", f"{topic}/{n % 100}/{other}.html#top", f"en/{n % 1000}?ref=home&page={j}", f"{n % 10000}?session={code}")[(i + 3 * j) % 8]
            allowed.append((f"http{'s' * ((i + j) % 3 > 0)}://{host}/{tail}", 0))
    return blocked + allowed


def host_path_sql(url: str = "url", dialect: str = "spark") -> tuple[str, str]:
    """SQL of host and path; both empty for a null URL or one without ``://``."""
    at = f"strpos({url}, '://')" if dialect == "duckdb" else f"instr({url}, '://')"
    rest = f"substr({url}, {at} + 3)"
    extract = "regexp_extract({}, '{}', 1)"
    has = f"coalesce({at}, 0) > 0"
    host = extract.format(rest, "^([^/?#]*)")
    path = extract.format(rest, "^[^/?#]*([^?#]*)")
    lower = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN {has} THEN {lower} ELSE '' END", f"CASE WHEN {has} THEN {path} ELSE '' END"


def rule_sql(rules: Sequence[tuple[str, str, str]]) -> tuple[str, str]:
    """SQL of the longest fitting rule and of its verdict over columns host and path; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def case(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = {text(h)} OR right(host, {len(h) + 1}) = {text('.' + h)}) AND left(path, {len(p)}) = {text(p)} THEN {text(value(h, p, v))}" for h, p, v in ordered) + " END"

    return (case(lambda h, p, v: h + p), case(lambda h, p, v: v)) if ordered else ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)")


# Lexical features over columns u (the URL, null as empty), host and path, in both dialects and in Python.
FEATURES = ("length", "host_length", "depth", "digits", "letters", "entropy", "parameters", "hyphens", "labels", "suffix")


def feature_sql(suffix_rates: dict[str, float], dialect: str) -> dict[str, str]:
    """SQL of each feature.  Ratios are whole numbers per 1000, rounded down, so that both dialects agree."""
    duck = dialect == "duckdb"

    def count(column: str, kept: str) -> str:
        flags = ", 'g'" if duck else ""
        return f"length(regexp_replace({column}, '[^{kept}]', ''{flags}))"

    characters = "list_filter(string_split(u, ''), lambda c: c <> '')" if duck else "filter(split(u, ''), c -> c <> '')"
    if duck:
        sums = f"list_sum(list_transform(list_distinct({characters}), lambda c: (length(u) - length(replace(u, c, ''))) * ln(length(u) - length(replace(u, c, '')))))"
    else:
        sums = f"aggregate(array_distinct({characters}), 0D, (s, c) -> s + (length(u) - length(replace(u, c, ''))) * ln(length(u) - length(replace(u, c, ''))))"
    entropy = f"CASE WHEN length(u) > 0 THEN floor((ln(length(u)) - coalesce({sums}, 0) / length(u)) * 1000 / ln(2) + 0.000001) ELSE 0 END"
    end = "regexp_extract(host, '([^.]*)$', 1)"
    suffix = "500" if not suffix_rates else "CASE " + " ".join(f"WHEN {end} = '{s}' THEN {round(1000 * r)}" for s, r in sorted(suffix_rates.items())) + " ELSE 500 END"
    return {
        "length": "length(u)",
        "host_length": "length(host)",
        "depth": count("path", "/"),
        "digits": f"CASE WHEN length(u) > 0 THEN floor({count('u', '0-9')} * 1000 / length(u)) ELSE 0 END",
        "letters": f"CASE WHEN length(host) > 0 THEN floor({count('host', 'a-z')} * 1000 / length(host)) ELSE 0 END",
        "entropy": entropy,
        "parameters": count("u", "=&"),
        "hyphens": count("host", "-"),
        "labels": count("host", "."),
        "suffix": suffix,
    }


def features(url: str, suffix_rates: dict[str, float]) -> list[float]:
    """The same features in Python, for fitting."""
    host, path = _split(url)

    def count(text: str, pattern: str) -> int:
        return len(re.findall(pattern, text))

    counts = [url.count(c) for c in dict.fromkeys(url)]
    entropy = math.floor((math.log(len(url)) - sum(c * math.log(c) for c in counts) / len(url)) * 1000 / math.log(2) + 0.000001) if url else 0
    return [len(url), len(host), path.count("/"), count(url, "[0-9]") * 1000 // len(url) if url else 0, count(host, "[a-z]") * 1000 // len(host) if host else 0, entropy, count(url, "[=&]"), host.count("-"), host.count("."), round(1000 * suffix_rates[s]) if (s := host.rpartition(".")[2]) in suffix_rates else 500]


def _split(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    host = re.match(r"[^/?#]*", rest).group() if mark else ""
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if mark else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


class Trees:
    """Gradient-boosted regression trees for the logistic loss; a tree is (feature, bound, left, right) or a leaf value."""

    def __init__(self, labelled: Sequence[tuple[str, int]], rounds: int = 20, depth: int = 3, rate: float = 0.3):
        by: dict[str, list[int]] = {}
        for url, label in labelled:
            by.setdefault(_split(url)[0].rpartition(".")[2], []).append(label)
        self.suffix_rates = {s: (sum(v) + 1) / (len(v) + 2) for s, v in by.items() if re.fullmatch("[a-z0-9-]+", s)}
        rows = [features(u, self.suffix_rates) for u, _ in labelled]
        labels = [y for _, y in labelled]
        share = (sum(labels) + 1) / (len(labels) + 2)
        self.start = round(math.log(share / (1 - share)), 6)
        scores = [self.start] * len(rows)
        self.trees: list = []
        for _ in range(rounds if rows else 0):
            p = [1 / (1 + math.exp(-s)) for s in scores]
            tree = self._grow(rows, [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p], list(range(len(rows))), depth, rate)
            self.trees.append(tree)
            scores = [s + self._value(tree, r) for s, r in zip(scores, rows, strict=True)]

    def _grow(self, rows: list, slopes: list, bends: list, here: list[int], depth: int, rate: float):
        g, h = sum(slopes[i] for i in here), sum(bends[i] for i in here)
        leaf = round(rate * g / (h + 1), 6)
        best = (1e-6, None)
        if depth and len(here) > 4:
            for f in range(len(FEATURES)):
                order = sorted(here, key=lambda i: rows[i][f])
                a = b = 0.0
                for k, i in enumerate(order[:-1]):
                    a, b = a + slopes[i], b + bends[i]
                    if rows[i][f] != rows[order[k + 1]][f]:
                        gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, (rows[i][f] + rows[order[k + 1]][f]) / 2))
        if best[1] is None:
            return leaf
        f, bound = best[1]
        return (f, bound, *(self._grow(rows, slopes, bends, [i for i in here if (rows[i][f] < bound) == side], depth - 1, rate) for side in (True, False)))

    def _value(self, tree, row: list) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def score(self, url: str) -> float:
        row = features(url, self.suffix_rates)
        return self.start + sum(self._value(t, row) for t in self.trees)

    def sql(self) -> str:
        """The raw score over the feature columns, in millionths, so that the sum is exact."""

        def node(tree) -> str:
            if not isinstance(tree, tuple):
                return str(round(tree * 1_000_000))
            return f"CASE WHEN f_{FEATURES[tree[0]]} < {tree[1]} THEN {node(tree[2])} ELSE {node(tree[3])} END"

        return " + ".join([str(round(self.start * 1_000_000)), *(node(t) for t in self.trees)])


#: Labelled URLs of each class that ``fit`` takes at most.
SAMPLE_URLS = 2_000


def fit(labelled: DataFrame, each: int = SAMPLE_URLS) -> Trees:
    """Trees from a table of labelled URLs: url, and label, 1 to block or 0 to allow.

    Of either class the ``each`` different URLs of smallest hash are taken, so neither the
    table's size nor repeated rows change how much reaches the driver, and the result depends
    on the URLs alone.  Rows with a null, or another label, take no part; a table without
    any gives trees that allow everything.
    """
    rows = labelled.selectExpr("CAST(url AS STRING) AS url", "CAST(label AS INT) AS label").where("url IS NOT NULL AND label IN (0, 1)")
    rows = rows.withColumn("h", F.xxhash64("url").bitwiseAND(F.lit(2**63 - 1)))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    near = F.lit(False)
    for label, n in counts.items():  # two at most
        near |= (F.col("label") == label) & (F.col("h") <= min(2**63 - 1, (2**63 - 1) * (3 * each + 40) // (2 * max(1, n))))
    met = sorted(((r["label"], r["h"], r["url"]) for r in rows.where(near).distinct().collect()), key=lambda r: (r[1], r[2], r[0]))
    taken = [x for label in (1, 0) for x in [r for r in met if r[0] == label][:each]]
    return Trees([(url, label) for label, _, url in taken])


@lru_cache(maxsize=1)
def default_trees() -> Trees:
    return Trees(labelled_urls())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, trees: Trees | None = None) -> DataFrame:
    """Judge every page's URL, a row for each row of ``pages``.

    Returns page_id, host, path, rule (null without one), verdict and score, the trees'
    probability that the URL is to be blocked.  A null URL, or one without ``://``, has
    an empty host and path and fits no rule; the trees judge it as the empty URL or by what
    it has.  Rules of equal length cannot both fit one URL unless they are the same.  A very long URL is
    measured whole, repeated rows come back repeated, other columns are ignored and an
    empty table gives no rows.
    """
    trees = trees or default_trees()
    return _query(pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url"), rules, trees)


def _query(pages: DataFrame, rules: Sequence[tuple[str, str, str]], trees: Trees) -> DataFrame:
    host, path = host_path_sql()
    rule, verdict = rule_sql(rules)
    parts = pages.selectExpr("page_id", "coalesce(url, '') AS u", f"{host} AS host", f"{path} AS path")
    measured = parts.selectExpr("page_id", "host", "path", f"{rule} AS rule", f"{verdict} AS ruled", *(f"{x} AS f_{name}" for name, x in feature_sql(trees.suffix_rates, "spark").items()))
    scored = measured.selectExpr("page_id", "host", "path", "rule", "ruled", f"{trees.sql()} AS raw")
    return scored.selectExpr("page_id", "host", "path", "rule", f"coalesce(ruled, CASE WHEN raw > {round(BLOCK_ABOVE * 1_000_000)} THEN 'block' ELSE 'allow' END) AS verdict", "round(1 / (1 + exp(-raw / 1000000D)), 6) AS score")


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, trees: Trees | None = None) -> str:
    """The same in DuckDB's SQL over the table ``pages``."""
    trees = trees or default_trees()
    host, path = host_path_sql(dialect="duckdb")
    rule, verdict = (x.replace("AS STRING", "AS VARCHAR") for x in rule_sql(rules))
    measured = ", ".join(f"{x} AS f_{name}" for name, x in feature_sql(trees.suffix_rates, "duckdb").items())
    return (
        f"WITH parts AS (SELECT page_id, coalesce(url, '') AS u, {host} AS host, {path} AS path FROM pages), "
        f"measured AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled, {measured} FROM parts), "
        f"scored AS (SELECT page_id, host, path, rule, ruled, {trees.sql()} AS raw FROM measured) "
        f"SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN raw > {round(BLOCK_ABOVE * 1_000_000)} THEN 'block' ELSE 'allow' END) AS verdict, round(1 / (1 + exp(-raw / 1000000.0)), 6) AS score FROM scored"
    )
