"""Quality rules: a threshold table compiled into one projection of built-in expressions, without user functions.

Every figure of a document comes from its own row, so there is no shuffle and a hot source costs nothing extra.  Ratios
are compared as whole numbers (part * 1000 against bound * whole), so no rounding decides.

Defined cases: a null or empty text has no words, fails the length rule and is not kept; repeated rows are judged one
by one; other columns stay as they are (the figures are added, an older column of the same name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.llm.common import SPACE, table

NAME = "op5_quality_rules"

# Common function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in a is that for it was on are as with they be at this from have or by one had not but what all were when
de la le les des et en un une du que qui est dans pour au par sur pas avec ce il plus ne se son
der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las y del por con no una su para al lo como más o pero sus
""".split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """part / whole must lie within [least, most], each in thousandths; whole 0 passes unless the rule needs it."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The threshold table. ``n_words`` bounds come from the base rules; all are ratios in thousandths.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2000, most=15000),
    Rule("symbols_per_word", "n_symbols", "n_words", most=250),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
)
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at ascending positions."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("bigint").alias("n"), p.alias("last"))
    return F.aggregate(positions, zero, step, lambda acc: acc["n"])


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Each window is one number: the high bits of its hash over its place.  One sort brings windows of equal high bits
    together; those few are compared by their whole hashes.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))

    def near(low: Column) -> Column:
        """Hash and place of the windows that share their high bits; places are below ``low``, a power of two."""
        packed = F.sort_array(F.transform(starts, lambda i: window(i).bitwiseAND(-low) + i))
        close = lambda x, y: F.coalesce(x.bitwiseXOR(y).between(F.lit(0), low - 1), F.lit(False))
        twins = _let(packed, lambda s: F.filter(s, lambda x, k: close(x, F.get(s, k - 1)) | close(x, F.get(s, k + 1))))
        return F.transform(F.transform(twins, lambda x: x.bitwiseAND(low - 1).cast("int")), lambda i: F.struct(window(i).alias("h"), i.alias("i")))

    def same(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))

    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.size(words))))
    return _covered(F.sort_array(F.transform(_let(F.sort_array(_let(low, near)), same), lambda x: x["i"].cast("bigint"))))


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """``_row`` (the columns of docs) and ``_f`` (all figures) of every row.

    The row number within ``_f`` is not deterministic, so the optimizer computes ``_f`` once for each row, whatever reads
    or filters it later, and never moves a part of it into a filter.
    """
    t, long = F.coalesce(F.col("_text"), F.lit("")), lambda c: c.cast("bigint")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    stop = sorted(set(STOP_WORDS))
    out = out.withColumns({"_w": F.filter(F.split(t, SPACE), lambda w: w != ""), "_l": lines})
    f = {
        "n_words": long(F.size("_w")),
        "word_chars": long(F.length(F.translate(t, " \t\n\x0b\f\r", ""))),
        "n_symbols": long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
        "n_stop_words": long(F.size(F.filter("_w", lambda w: w.isin(stop)))),
        "n_lines": long(F.size("_l")),
        "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_repeat_words": long(_repeated(F.col("_w"))),
        "_number": F.monotonically_increasing_id(),
    }
    return out.select("_row", F.struct(*[v.alias(k) for k, v in f.items()]).alias("_f"))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def compiled(rules=RULES, figure=F.col) -> dict[str, Column]:
    """A boolean column for each rule: true if the document passes."""
    out = {}
    for r in rules:
        part, whole = figure(r.part) * 1000, figure(r.whole)
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (part >= r.least * whole)
        if r.most is not None:
            ok = ok & (part <= r.most * whole)
        out[f"ok_{r.name}"] = ok
    return out


def verdicts(rules=RULES) -> dict[str, Column]:
    """``base_failed``, a column for each rule, and ``kept``, over the figures in ``_f``."""
    of = lambda k: F.col("_f")[k]
    base = (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEATED * of("n_words"))
    checks = compiled(rules, of)
    return {"base_failed": base, **checks, "kept": reduce(lambda a, b: a & b, checks.values(), ~base)}


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The columns of docs, the figures, ``base_failed``, a column for each rule and ``kept``."""
    added = {k: F.col("_f")[k] for k in FIGURES} | verdicts(rules)
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return _measured(docs, text).select(*own, *[v.alias(k) for k, v in added.items()])


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return _measured(docs, text).where(verdicts(rules)["kept"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
_VERDICT = " AND ".join(
    x
    for r in RULES
    for x in ([f"{r.part} * 1000 >= {r.least} * {r.whole}"] if r.least is not None else []) + ([f"{r.part} * 1000 <= {r.most} * {r.whole}"] if r.most is not None else [])
)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for the figures and the verdict, from the same threshold table."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM {docs}),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
p AS (SELECT r, i + o AS i FROM c, (VALUES (0), (1), (2)) v(o) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n FROM p GROUP BY r),
ws AS (SELECT r, count(*) AS n, sum(length(w)) AS c, count(*) FILTER (w IN ({_STOP_SQL})) AS s FROM w GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
ls AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.doc_id, coalesce(ws.n, 0)::BIGINT AS n_words, coalesce(ws.c, 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(ls.n - ls.u, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ws.s, 0)::BIGINT AS n_stop_words, coalesce(ls.n, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN ws USING (r) LEFT JOIN ls USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_VERDICT}) AS kept FROM b
"""


ORACLE = oracle()
