"""URL filter: hand-written host and path rules, and association rules that are mined from labelled URLs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shellac.llm.common import discard, materialise

#: Host, path and verdict; the longest rule that fits decides.
DEFAULT_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
_ASCII = {c: c + 32 for c in range(65, 91)}
_HOST, _PATH, _SPLIT = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*"), re.compile(r"[^0-9A-Za-z\x80-\U0010FFFF]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or
    the end); both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = _HOST.match(rest)[0]
    return host.translate(_ASCII), _PATH.match(rest[len(host) :])[0]


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL: host labels, neighbouring host labels, path words, query keys; digits become ``0``."""
    host, path = split_url(url)
    labels = [x for x in host.split(".") if x]
    out = {f"host={x}" for x in labels} | {f"site={a}.{b}" for a, b in zip(labels, labels[1:])}
    out |= {f"path={re.sub('[0-9]+', '0', x)}" for x in _SPLIT.split(path) if x}
    query = (url or "").partition("?")[2].partition("#")[0]
    out |= {f"query={x.partition('=')[0]}" for x in query.split("&") if x}
    return sorted(out)


def tokenise(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``tokens`` of each row's url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array([url_tokens(u) for u in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], tokens], [*b.schema.names[1:], "tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    return pages.select("url", *keep).mapInArrow(run, ", ".join([*fields, "tokens array<string>"]))


@dataclass(frozen=True)
class MinedRule:
    """A URL fits if it has a token of every group. Tokens of one group stand on the same labelled pages, so any of them does."""

    groups: tuple[frozenset[str], ...]
    confidence: float
    support: float

    def fits(self, tokens: set[str]) -> bool:
        return not any(g.isdisjoint(tokens) for g in self.groups)


def _passes(n: Column, b: Column, base: float, tests: int, min_confidence: float, z: float, false_rules: float) -> Column:
    """Whether ``b`` blocked ones of ``n`` pages make a rule: by the lower end of Wilson's interval of the confidence, and by
    Chernoff's bound on the chance of as many at the base rate, for all ``tests`` together."""
    share = b / n
    lower = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    clean = F.when(b < n, (n - b) * F.log((1 - share) / (1 - base))).otherwise(0.0) if base < 1 else F.lit(0.0)
    return (lower >= min_confidence) & (share > base) & (b * F.log(share / base) + clean >= math.log(max(1, tests) / false_rules))


def _items(shapes: DataFrame, least: int) -> list[Row]:
    """Groups of tokens that stand on the same pages, ``least`` blocked ones or more: tokens, n pages, b blocked ones."""
    each = shapes.select(F.explode("tokens").alias("token"), "n", "b", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g"))
    tokens = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("c"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("b") >= least)
    return tokens.groupBy("n", "b", "c", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("tokens", "n", "b").orderBy("tokens").collect()


def _baskets(rows: DataFrame, ids: Mapping[str, int], label: int) -> DataFrame:
    """The items of each row's tokens, and ``label`` where it is blocked."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [sorted({known[t] for t in tokens if t in known}) + [label] * b for tokens, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["items"])

    return rows.select("tokens", "b").mapInArrow(run, "items array<int>")


def _without_larger(rules: DataFrame, minimal: Sequence[frozenset[int]]) -> DataFrame:
    """The rules that hold none of ``minimal``."""
    index: dict[int, list[frozenset[int]]] = {}
    for m in minimal:
        index.setdefault(min(m), []).append(m)
    shared = rules.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sets = [frozenset(x) for x in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([not any(m <= s for i in s for m in known.get(i, ())) for s in sets], pa.bool_()))

    return rules.mapInArrow(run, rules.schema)


def mine(labelled: DataFrame, min_pages: int = 5, min_support: float = 1e-4, min_confidence: float = 0.6, z: float = 1.645, false_rules: float = 0.1) -> list[MinedRule]:
    """Rules ``tokens -> block`` of a table (tokens, blocked), by Spark's FP-growth over all its rows: every minimal one.

    A rule's tokens stand on at least ``min_pages`` blocked pages and on ``min_support`` of all; the lower end of its confidence's
    interval (``z`` standard errors) reaches ``min_confidence``; and not even ``false_rules`` rules of this strength are to be
    expected by chance among all combinations that were looked at. Rules whose tokens hold those of another rule say
    nothing new and go, on the executors and by size, before anything larger is collected.

    FP-growth's work doubles with each token of a frequent shape, so what can't matter goes first, without a change of the
    result: tokens on the same pages become one item; an item that makes a rule alone is left out, as is one on blocked
    pages only, since with more tokens it would have no more confidence and fewer pages. Null labels and null tokens are left
    out; without blocked rows there are no rules.
    """
    rows = labelled.where(F.col("blocked").isNotNull() & F.col("tokens").isNotNull())
    rows = materialise(rows.select(F.array_sort(F.array_distinct(F.array_compact("tokens"))).alias("tokens"), F.col("blocked").cast("int").alias("b")), "labelled")
    spark = rows.sparkSession
    shapes = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    pages, blocked = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not blocked:
        discard(rows)
        return []
    least, base = max(min_pages, math.ceil(min_support * pages)), blocked / pages
    items = _items(shapes, least)
    mixed = [i for i, r in enumerate(items) if r["b"] < r["n"]]
    label = len(items)
    scratch = [rows]
    found = None
    if len(mixed) > 1:
        baskets = materialise(_baskets(rows, {t: i for i in mixed for t in items[i]["tokens"]}, label), "baskets")
        scratch.append(baskets)
        # the half keeps a rounding error of the share from losing a set that has just enough pages
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / pages, minConfidence=min_confidence).fit(baskets)
        own = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == label))
        counted = own.select(F.array_sort("antecedent").alias("set"), F.round(F.col("support") * pages).alias("b"), F.round(F.col("support") * pages / F.col("confidence")).alias("n"))
        found = materialise(counted, "rules")
        scratch.append(found)
    tests = len(items) + (found.count() if found is not None else 0)
    alone = spark.createDataFrame([([i], float(r["b"]), float(r["n"])) for i, r in enumerate(items)], "set array<int>, b double, n double")
    passed = (alone if found is None else alone.unionByName(found.where(F.size("set") > 1))).where(_passes(F.col("n"), F.col("b"), base, tests, min_confidence, z, false_rules))
    passed = materialise(passed, "passed")
    scratch.append(passed)
    chosen: list[Row] = []
    size = 1
    while passed.where(F.size("set") >= size).limit(1).count():
        chosen += _without_larger(passed.where(F.size("set") == size), [frozenset(r["set"]) for r in chosen]).collect()
        size += 1
    for t in scratch:
        discard(t)
    rules = [MinedRule(tuple(frozenset(items[i]["tokens"]) for i in sorted(r["set"])), r["b"] / r["n"], r["b"] / pages) for r in chosen]
    return sorted(rules, key=lambda m: (-m.confidence, -m.support, [sorted(g) for g in m.groups]))


class Matcher:
    """Inverted indexes over both kinds of rules: hand-written ones by host, mined ones by the tokens of their rarest group."""

    def __init__(self, rules: Mapping[str, str], mined: Sequence[MinedRule]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        uses: dict[frozenset[str], int] = {}
        for m in mined:
            for g in m.groups:
                uses[g] = uses.get(g, 0) + 1
        self.by_token: dict[str, list[MinedRule]] = {}
        for m in mined:
            for t in min(m.groups, key=lambda g: (uses[g], sorted(g))):
                self.by_token.setdefault(t, []).append(m)

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest hand-written rule that fits, and its verdict; of equally long ones the last in code-point order."""
        found, at = [], 0
        while host:
            found += [(len(r), r, v) for p, r, v in self.by_host.get(host[at:], ()) if path.startswith(p)]
            at = host.find(".", at) + 1
            if not at:
                break
        return max(found)[1:] if found else (None, None)

    def mined(self, tokens: Sequence[str]) -> MinedRule | None:
        """The strongest mined rule that the URL fits."""
        own = set(tokens)
        fits = [m for t in tokens for m in self.by_token.get(t, ()) if m.fits(own)]
        return max(fits, key=lambda m: (m.confidence, m.support, [sorted(g) for g in m.groups]), default=None)


def judge(pages: DataFrame, mined: Sequence[MinedRule], rules: Mapping[str, str] = DEFAULT_RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and mined_rule (the tokens that fit it, null without) to every row, in Arrow batches, no shuffle.

    A hand-written rule fits its host and all subdomains if the path starts with the rule's; the longest decides. Where
    none fits, a mined rule blocks and anything else is allowed. Null urls have an empty host and path and are
    allowed; columns of the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "mined_rule")
    names = [c for c in pages.columns if c not in added]
    at = names.index(url)
    shared = pages.sparkSession.sparkContext.broadcast(Matcher(rules, mined))  # bounded by the support that mine() asks for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out: list[tuple] = []
            for u in b.column(at).to_pylist():
                host, path = split_url(u)
                rule, verdict = m.rule(host, path)
                tokens = url_tokens(u) if rule is None else []
                found = m.mined(tokens)
                out.append((host, path, rule, verdict or ("block" if found else "allow"), " ".join(t for t in tokens if any(t in g for g in found.groups)) if found else None))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[i] for x in out], pa.string()) for i in range(5)]], [*names, *added])

    chosen = pages.select(*[F.col(f"`{c}`") for c in names])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    return chosen.mapInArrow(run, ", ".join([*fields, *[f"{c} string" for c in added]]))
