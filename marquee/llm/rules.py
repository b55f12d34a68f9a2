"""Quality rules: a ledger of failure bits and measurements, and policies applied to it.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule, so a policy (a versioned mask of rules that count) is a bitwise AND, and
the effect of leaving a rule out is a bitwise aggregation that reads no text.

Defined results: a null or empty text has no words and fails ``few_words``; a text of fewer
than five words has no repeated windows; rows are judged one by one, so null ids, repeated
rows and other columns change nothing; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, text_of, words

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str          # SQL over the measurements


#: The place of a rule is its bit: append, never reorder.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_upper > 50 * word_chars"),
    Rule("shouts", "100 * n_shouts > 5 * word_chars"),
    Rule("long_words", "word_chars > 40 * n_words"),
)
BITS = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", BASE.rules + ("symbols", "repeated_lines", "capitals", "shouts", "long_words")))}
CURRENT = POLICIES["v1"]


def _only(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measured(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the measurements as further columns, named with ``prefix``.

    All work is within the row: windows are hashed (64 bits of their five words), and only a
    text whose window hashes are not all different goes on to the sort that finds the places.
    """
    p = f"{prefix}tmp_"
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, h, g, s, at = (F.col(p + x) for x in ("words", "hashes", "grams", "sorted", "places"))
    out = docs.withColumns({p + "words": words(text), p + "lines": lines})
    out = out.withColumns({
        prefix + "n_words": F.size(w).cast("long"),
        prefix + "word_chars": F.length(F.array_join(w, "")).cast("long"),
        prefix + "n_symbols": _only(text, "#*$%&|<>"),
        prefix + "n_lines": F.size(p + "lines").cast("long"),
        prefix + "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"),
        prefix + "n_upper": _only(text, "A-Z"),
        prefix + "n_shouts": _only(text, "!"),
        p + "hashes": F.transform(w, lambda x: F.xxhash64(x)),
    }).drop(p + "words", p + "lines")
    starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
    none = F.array().cast("array<bigint>")
    out = out.withColumn(
        p + "grams",
        F.when(F.size(h) > WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))).otherwise(none),
    ).drop(p + "hashes")
    pairs = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
    out = out.withColumn(p + "sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(pairs))).drop(p + "grams")
    same = lambda x, i, k: F.coalesce(F.get(s, i + k)["g"] == x["g"], F.lit(False))
    places = F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])
    out = out.withColumn(p + "places", F.sort_array(places)).drop(p + "sorted")
    covered = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn(prefix + "n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(p + "places")
    # a later filter must not be pushed below this point: it would evaluate the rules a second time
    once = F.inline(F.array(F.struct(*(F.col(prefix + m) for m in MEASURES))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), once)


def failures(prefix: str = "") -> Column:
    """The bits of the rules that fail, from the measurements."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        sql = r.fails
        for m in MEASURES:
            sql = sql.replace(m, f"`{prefix}{m}`") if prefix else sql
        bits = bits + F.when(F.expr(sql), F.lit(BITS[r.name])).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failures``, one row per row of ``docs``."""
    return measured(docs.select("doc_id", "text")).drop("text").withColumn("failures", failures())


def passes(policy: Policy, failed: Column | str = "failures") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects."""
    hit = F.col("failures").bitwiseAND(F.lit(policy.mask))
    bits = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules))
    one = book.groupBy(hit.alias("hit")).agg(F.count("*").alias("n")).withColumn("r", F.explode(bits))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
    )


def passing(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    book = measured(docs, "rule_ledger_").withColumn("rule_ledger_failures", failures("rule_ledger_"))
    return book.where(passes(policy, "rule_ledger_failures")).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB: the ledger of a relation ``{src}`` with doc_id and text.
LEDGER_SQL = r"""
SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_upper > 50 * word_chars THEN 16 ELSE 0 END + CASE WHEN 100 * n_shouts > 5 * word_chars THEN 32 ELSE 0 END
  + CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures
FROM (
  SELECT b.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_shouts, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM book b LEFT JOIN repeats r USING (rid)
)
"""
LEDGER_CTES = r"""
base AS (SELECT row_number() OVER () AS rid, * FROM {src}),
book AS (
  SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
),
spots AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM book WHERE len(w) >= 5),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i + 4]) AS c FROM spots),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM grams WHERE c > 1) GROUP BY rid)
"""
