"""Quality rules as one native projection.

A table of thresholds is compiled into Spark expressions over length, symbol, stop-word and line ratios. No Python runs on the
executors: words come from one regular expression, the rest from array functions, and no rows are exploded or shuffled, so a
text of any length stays one row and nothing depends on keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the characters that count as symbols.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "als am auf aus das dem den der des die ein eine einen einer für im ist mit nicht sich und von zu "
    "au aux ce dans des du elle en est et il la le les on par pas pour que qui sur un une "
    "al como con de del el es la las los mas no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``ratio`` lies in [least, most]; ``ratio`` is SQL over the columns of ``measured``."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        x, ok = F.expr(self.ratio), F.lit(True)
        if self.least is not None:
            ok = ok & (x >= self.least)
        if self.most is not None:
            ok = ok & (x <= self.most)
        return F.coalesce(ok, F.lit(True))


RULES = (
    Rule("mean word length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols per word", "n_symbols / n_words", most=0.3),
    Rule("exclamation marks per word", "n_bangs / n_words", most=0.4),
    Rule("stop words per word", "n_stop_words / n_words", least=0.02),
    Rule("repeated lines per line", "n_dup_lines / n_lines", most=0.6),
)


def measured(docs: DataFrame, stop_words: list[str] = STOP_WORDS, row: str | None = None) -> DataFrame:
    """doc_id and the counts that rules build on; the column ``row`` too, as it is, if one is named.

    Null text: no words, all counts 0. Ties and repeated rows: each row is measured alone. Empty table: no rows.
    """
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[row] * bool(row),
    ).select(
        "doc_id",
        "text",
        *[row] * bool(row),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\x09\x0b\x0c\x0d", "    ")) != "").alias("lines"),
    )
    # Windows of three words, as hashes of the words with the length of each, which keeps them apart.
    windows = words.select(
        "doc_id",
        *[row] * bool(row),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(words, w -> lower(w) in ({quoted})))").cast("long").alias("n_stop_words"),
        F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))").alias("windows"),
    )
    # Only a text that has a window twice is sorted.
    ordered = windows.withColumn(
        "ordered",
        F.expr("case when size(windows) > size(array_distinct(windows)) then sort_array(transform(windows, (h, i) -> struct(h, i))) else array() end"),
    )
    places = ordered.withColumn(
        "places",
        F.expr("sort_array(transform(filter(ordered, (x, j) -> coalesce(x.h = get(ordered, j - 1).h, false) or coalesce(x.h = get(ordered, j + 1).h, false)), x -> x.i))"),
    )
    # The partition's number keeps filters on the result above this projection: pushed below, each would repeat all of the
    # array expressions many times over.
    repeated = F.expr("aggregate(transform(places, (p, j) -> least(3, coalesce(get(places, j + 1) - p, 3))), 0L, (a, x) -> a + x)")
    return places.select(*(c for c in windows.columns if c != "windows"), F.when(F.spark_partition_id() >= 0, repeated).alias("n_repeat_words"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, row: str | None = None) -> DataFrame:
    """``measured`` with base_failed, kept, and the number of rules that each text fails."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = sum(((~r.holds()).cast("int") for r in rules), F.lit(0))
    return measured(docs, row=row).withColumn("base_failed", base).withColumn("n_failed_rules", F.when(F.col("n_words") == 0, 0).otherwise(failed)).withColumn("kept", ~F.col("base_failed") & (F.col("n_failed_rules") == 0))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, over a table documents."""
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    bad = " + ".join(
        f"(case when {' or '.join([f'{r.ratio} < {r.least}'] * (r.least is not None) + [f'{r.ratio} > {r.most}'] * (r.most is not None))} then 1 else 0 end)" for r in rules
    )
    return f"""
with words as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
placed as (
  select r, unnest(range(1, len(w) - 1)) as i, w from words where len(w) >= 3),
windows as (
  select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from placed),
covered as (
  select r, count(distinct i + k) as n from windows, range(0, 3) s(k) where n >= 2 group by r),
counted as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_bangs,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         len(list_filter(w, lambda x: lower(x) in ({quoted})))::bigint as n_stop_words,
         coalesce(covered.n, 0)::bigint as n_repeat_words
  from words left join covered using (r)),
based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         (case when n_words = 0 then 0 else {bad} end)::integer as n_failed_rules from counted)
select *, not base_failed and n_failed_rules = 0 as kept from based"""
