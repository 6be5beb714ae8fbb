"""Quality rules: a decision list learnt by sequential covering, emitted as ordered Spark conditions.

Statistics of each whole text are taken in one narrow pass. From labelled statistics, rules that catch low
quality are learnt one after another: a rule grows by the threshold test of the best information gain on the
growing part, is pruned from its end while that helps on the pruning part, and the rows it covers are
removed. The list becomes ``when(rule 1, false).when(rule 2, false)...otherwise(true)``.

Defined results: a null text counts as empty (all statistics 0, base_failed true); rates of texts without
words are 0; repeated rows get equal results; without labels the list is empty and keeps what the base tests
keep; empty tables give empty results. Other columns are carried on request only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, map_batches

MAX_TRAIN_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_exclaim long, n_digits long, n_distinct long, n_lines long"
#: Rates that rules may test, as Spark SQL over the statistics.
RATES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words_d": "cast(n_words as double)",
}


def repeated_words(ids: np.ndarray, distinct: int, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more; windows are packed exactly, never hashed."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code, base = ids[:n].astype(np.uint64), max(1, distinct)
    span = base
    for k in range(1, width):
        if span * base >= 1 << 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            span = int(code.max()) + 1
        code = code * np.uint64(base) + ids[k : n + k].astype(np.uint64)
        span *= base
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(hist[[32, 9, 10, 11, 12, 13]].sum())
    chars = int(hist[:128].sum() + hist[192:].sum()) - spaces  # code points: bytes that do not continue one
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    return (len(tokens), chars, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(ids, len(number)), int(hist[65:91].sum()), int(hist[33]), int(hist[48:58].sum()), len(number), len(lines))


def statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    names = [x.split()[0] for x in STATS.split(", ")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = {"doc_id": fields[id_col]} | {c: fields[c] for c in keep if c != "doc_id" and c not in names}
    given = docs.select(F.col(text_col).alias("__t"), *(F.col(id_col if c == "doc_id" else c) for c in out))

    def run(t, *kept):
        return dict(zip(out, kept, strict=True)) | dict(zip(names, zip(*map(stats_of, t), strict=True), strict=True))

    return map_batches(given, run, ", ".join(f"`{c}` {k}" for c, k in out.items()) + ", " + STATS)


@dataclass(frozen=True)
class Test:
    rate: str
    above: bool
    at: float

    def sql(self) -> str:
        return f"({RATES[self.rate]}) {'>=' if self.above else '<'} {self.at!r}D"


def _covers(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        out &= (x[t.rate] >= t.at) if t.above else (x[t.rate] < t.at)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[Test]:
    rule: list[Test] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (~bad & live).any():
        p, n = (bad & live).sum(), (~bad & live).sum()
        best, gain = None, 1e-9
        for rate, v in x.items():
            cuts = np.unique(np.quantile(v[live], np.linspace(0.02, 0.98, 49)))
            order = np.argsort(v[live], kind="stable")
            sv, sb = v[live][order], np.concatenate([[0], np.cumsum(bad[live][order])])
            for c in cuts:
                k = int(np.searchsorted(sv, c))
                for above, pp, all_ in ((True, p - sb[k], len(sv) - k), (False, sb[k], k)):
                    if pp > 0 and all_ and (g := pp * (np.log2(pp / all_) - np.log2(p / (p + n)))) > gain:
                        best, gain = Test(rate, above, float(c)), g
        if best is None:
            break
        rule.append(best)
        live &= _covers([best], x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, most_rules: int = 12, precision: float = 0.8) -> list[list[Test]]:
    """Sequential covering over bounded labelled rows: grow, prune, keep while precise on the pruning part."""
    rules: list[list[Test]] = []
    live = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & live & ~prune).sum() >= 5:
        of = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(of(live & ~prune), bad[live & ~prune])
        if not rule:
            break

        def worth(r: list[Test], m=live & prune) -> float:
            hit = _covers(r, of(m))
            p, n = (hit & bad[m]).sum(), (hit & ~bad[m]).sum()
            return (p + 1) / (p + n + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x) & live
        if ((hit & bad).sum() + 1) / (hit.sum() + 2) < precision or worth(rule) < 0.5:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, seed: int = 3) -> list[list[Test]]:
    """Rules from at most ``max_rows`` labelled rows; only their rates reach the driver."""
    sample = bounded_labels(labels, label_col, max_rows, seed)
    stats = statistics(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), keep=("label",))
    measured = [x.split()[0] for x in STATS.split(", ")]
    stats = stats.groupBy("doc_id").agg(F.min(F.struct("label", *measured)).alias("r")).select("doc_id", "r.*")  # one row an id, however often it repeats
    got = stats.select("label", (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) == 0).alias("prune"), *(F.expr(e).cast("double").alias(k) for k, e in RATES.items())).toPandas()
    if not len(got) or got["label"].nunique() < 2:
        return []
    return learn({k: got[k].to_numpy() for k in RATES}, (got["label"] == 0).to_numpy(), got["prune"].to_numpy())


def verdict(rules: list[list[Test]]) -> Column:
    """The ordered Spark conditional expression of a decision list."""
    out = None
    for rule in rules:
        test = F.expr(" AND ".join(t.sql() for t in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    stats = statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
