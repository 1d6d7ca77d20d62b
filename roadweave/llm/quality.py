"""Quality rules with thresholds whose false rejections are limited by exact binomial tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded, stored, unused

# The base rules.
FEWEST, REPEATED = 20, 30
SYMBOLS, WINDOW = "#*$%&|<>", 8

#: Rules: a name, a quotient of two measures of a text, and its cutoffs from the most lenient
#: to the strictest. A text whose quotient is above a cutoff is rejected by it, or below it where
#: the cutoffs rise. A quotient by 0 rejects nothing.
RULES = (
    ("symbols", "n_symbols", "n_words", (2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25, 0.1)),
    ("long_words", "word_chars", "n_words", (16.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5)),
    ("short_words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5, 3.75, 4.0)),
    ("dup_lines", "n_dup_lines", "n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    ("repeats", "n_repeat_words", "n_words", (0.28, 0.25, 0.2, 0.15, 0.1, 0.05)),
)
#: All rules together reject at most this share of the good texts of each stratum, and that
#: holds in all strata at once with probability 1 - DELTA.
RISK, DELTA = 0.02, 0.05
#: Strata are broadcast up to this many.
STRATA = 100_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _named(c: Column, made) -> Column:
    """``made(c)`` with ``c`` computed once: a one-element array gives it a name."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that is found twice or more.

    Windows are compared by 64-bit hashes of the hashes of their words. Only a text with an
    equal pair sorts its windows.
    """

    def counted(found: Column) -> Column:
        n = F.size(found)
        last = F.lit(window)
        gap = lambda i: F.least(F.get(found, i + 1) - F.get(found, i), last)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.coalesce(gap(i), last))

    def doubles(rows: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return _named(F.sort_array(F.transform(places, lambda i: F.get(rows, i)["at"])), counted)

    def checked(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_named(ranked, doubles))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - window + 1)
        return _named(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), checked)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, 0).otherwise(_named(hashes, windows))


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` without ``text``, with the columns of MEASURES and n_lines (long).

    Words lie between ASCII white space, lines between \\n; a line counts if it holds a word,
    and as a duplicate if it equals an earlier one. Null and empty texts measure 0.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of_words(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).alias("n"), chars.alias("chars"), repeated_words(w).alias("repeats"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("different"))

    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, lin = unused(docs, "_w"), unused(docs, "_l")
    rows = docs.select(
        *kept,
        _named(words, of_words).alias(w),
        _named(lines, of_lines).alias(lin),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).alias(f"{w}s"),
    )
    return rows.select(
        *kept,
        F.col(w)["n"].cast("long").alias(f"{prefix}n_words"),
        F.col(w)["chars"].cast("long").alias(f"{prefix}word_chars"),
        F.col(f"{w}s").cast("long").alias(f"{prefix}n_symbols"),
        (F.col(lin)["n"] - F.col(lin)["different"]).cast("long").alias(f"{prefix}n_dup_lines"),
        F.col(w)["repeats"].cast("long").alias(f"{prefix}n_repeat_words"),
        F.col(lin)["n"].cast("long").alias(f"{prefix}n_lines"),
    )


def base_failed() -> Column:
    """The base rules: too few words, or too many of them repeated."""
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) of a binomial X of n draws at ``risk``; 1 where k is n * risk or more.

    Terms follow one another in logarithms, so none is lost for large n.
    """
    odds = F.log(F.lit(risk / (1 - risk)))
    step = lambda acc, j: F.struct(
        (acc["t"] + F.log((n - j) / (j + 1)) + odds).alias("t"), (acc["p"] + F.exp(acc["t"])).alias("p")
    )
    first = F.struct((n * F.log(F.lit(1 - risk))).alias("t"), F.lit(0.0).alias("p"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, step, lambda acc: acc["p"])
    return F.when(k < n * risk, total).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class Control:
    """What is promised: rules, the share of good texts rejected at most, and the chance of failing."""

    rules: tuple = RULES
    risk: float = RISK
    delta: float = DELTA


def levels(rules: tuple) -> Column:
    """For each rule the number of its cutoffs, the strictest first, that reject a text."""

    def hits(top: str, bottom: str, cutoffs: tuple) -> Column:
        value = F.try_divide(F.col(top), F.col(bottom))
        rising = cutoffs[-1] > cutoffs[0]
        return F.coalesce(sum(((value < c) if rising else (value > c)).cast("int") for c in cutoffs), F.lit(0))

    return F.array(*[hits(*rule[1:]) for rule in rules])


def thresholds(labelled: DataFrame, control: Control = Control()) -> DataFrame:
    """(stratum, rule, cutoff, n_good, false_rejections, p_value): the cutoff chosen for each.

    ``labelled`` holds stratum, good (boolean) and the measures of labelled texts that take
    no other part: the holdout. For each stratum and rule the hypothesis "more than
    risk / rules of the good texts are rejected" is tested by the exact binomial tail, from
    the most lenient cutoff on until one is not refuted (tests in a fixed order need no
    correction among them); each sequence has the level delta / (strata * rules). That is the
    same as asking that the upper Clopper-Pearson bound be below the limit. Of the cutoffs
    passed, that with the most bad less good rejections is chosen, the most lenient of
    equals; a sequence without a gain has no row.
    """
    rules = control.rules
    risk = control.risk / len(rules)
    sizes = F.array(*[F.lit(len(c)) for *_, c in rules])
    found = (
        labelled.filter("good is not null")
        .select("stratum", "good", F.posexplode(levels(rules)).alias("rule", "hits"))
        .groupBy("stratum", "rule", "hits")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    whole = found.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"),
        F.collect_list(F.struct("hits", "good", "bad")).alias("counts"),  # one for each number of hits
    )
    # cutoff i of m (from 0) is exceeded by texts with more than i hits: the most lenient first
    size = F.get(sizes, F.col("rule"))
    lost = lambda name: F.aggregate(
        "counts",
        F.lit(0).cast("long"),
        lambda acc, c: acc + F.when(c["hits"] >= size - F.col("at"), c[name]).otherwise(0),
    )
    tested = (
        whole.withColumn("at", F.explode(F.sequence(F.lit(0), size - 1)))
        .withColumn("false_rejections", lost("good"))
        .withColumn("caught", lost("bad"))
        .drop("counts")
        .withColumn("p_value", tail(F.col("false_rejections"), F.col("n_good"), risk))
    )
    strata = F.broadcast(found.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))).alias("strata")))
    level = F.lit(control.delta) / (F.col("strata") * len(rules))
    order = F.sort_array(F.collect_list(F.struct("at", "passed", "caught", "false_rejections", "p_value")))
    sequence = tested.crossJoin(strata).withColumn("passed", F.col("p_value") <= level).groupBy("stratum", "rule", "n_good").agg(order.alias("seq"))
    stop = F.array_position(F.transform("seq", lambda x: x["passed"]), False)
    within = F.when(stop == 0, F.col("seq")).otherwise(F.slice("seq", 1, F.greatest(stop - 1, F.lit(0)).cast("int")))
    gains = F.transform(
        within,
        lambda x: F.struct(
            (x["caught"] - x["false_rejections"]).alias("gain"),
            (-x["at"]).alias("order"),
            x["false_rejections"].alias("false_rejections"),
            x["p_value"].alias("p_value"),
        ),
    )
    values = F.array(*[F.array(*map(F.lit, c)) for *_, c in rules])
    return (
        sequence.withColumn("best", F.array_max(gains))
        .filter("best.gain > 0")
        .select(
            "stratum",
            "rule",
            F.get(F.get(values, F.col("rule")), -F.col("best.order")).alias("cutoff"),
            (-F.col("best.order")).alias("at"),
            "n_good",
            "best.false_rejections",
            "best.p_value",
        )
    )


def rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    control: Control = Control(),
) -> DataFrame:
    """One row per row of ``docs``: key, MEASURES, base_failed, kept, failed (names of the rules that reject).

    ``labels`` has the key and quality (1 good, 0 bad). A key with several labels counts as
    bad if any of them is 0; null keys and null labels teach nothing. The holdout is every
    labelled row that passes the base rules. Rows without a stratum form one; a stratum with
    too few labelled rows rejects by the base rules alone. Null and empty texts fail the base
    rules. Repeated rows give a row each; other columns of ``docs`` are not read.
    """
    measured = stored(
        measures(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), F.col(f"`{text}`").alias("text"))),
        "quality-measures",
    )
    marks = (
        labels.filter("quality is not null")
        .groupBy(F.col(f"`{key}`").alias("doc_id"))
        .agg((F.min("quality") > 0).alias("good"))
    )
    holdout = measured.filter(~base_failed()).join(marks, "doc_id")
    chosen = stored(thresholds(holdout, control), "quality-thresholds")
    limits = chosen.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "at"))).alias("_limits")
    )
    sizes = [len(c) for *_, c in control.rules]
    hits = levels(control.rules)
    names = [
        F.when(F.get(hits, F.lit(i)) >= F.lit(sizes[i]) - F.col("_limits")[F.lit(i)], F.lit(name))
        for i, (name, *_) in enumerate(control.rules)
    ]
    judged = (
        measured.join(bounded(limits, STRATA), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed", F.array_compact(F.array(*names)))
    )
    return judged.select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"
    )


def oracle(control: Control = Control()) -> str:
    """The same for ``documents`` and ``labels``, windows as joined words and tails by the gamma function."""
    grid = ", ".join(
        f"({i}, {at}, {x}::double, {1 if c[-1] < c[0] else -1})" for i, (*_, c) in enumerate(control.rules) for at, x in enumerate(c)
    )
    value = " ".join(f"when {i} then {a}::double / nullif({b}, 0)" for i, (_, a, b, _) in enumerate(control.rules))
    risk = control.risk / len(control.rules)
    w = r"[^\x20\x09-\x0D]+"
    return rf"""
with d as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '{w}') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{w}')) as ls
  from documents),
word as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
win as (select r, i, string_agg(word, ' ') over next as win, count(*) over next as n
  from word window next as (partition by r order by i rows between current row and {WINDOW - 1} following)),
twice as (select r, i, count(*) over (partition by r, win) as c from win where n = {WINDOW}),
gap as (select r, least({WINDOW}, coalesce(lead(i) over (partition by r order by i) - i, {WINDOW})) as g from twice where c > 1),
rep as (select r, sum(g)::bigint as n_repeat_words from gap group by r),
m as (
  select r, doc_id, lang, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(ls)::bigint as n_lines
  from d left join rep using (r)),
b as (select *, n_words < {FEWEST} or 100 * n_repeat_words > {REPEATED} * n_words as base_failed from m),
grid as (select * from (values {grid}) v(rule, step, cutoff, way)),
hit as (
  select r, lang, rule, step, coalesce(way * case rule {value} end > way * cutoff, false) as hit from b, grid),
marks as (select doc_id, min(quality) > 0 as good from labels where quality is not null group by doc_id),
held as (select b.r, b.lang, good from b join marks using (doc_id) where not base_failed),
tested as (
  select held.lang, rule, step, count(*) filter (good) as n, count(*) filter (good and hit) as k,
    count(*) filter (not good and hit) as caught
  from held join hit using (r) group by all),
strata as (select count(distinct coalesce('=' || lang, '')) as strata from held),
p as (
  select lang, rule, step, k, caught, case when k < n * {risk!r} then
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r})))) else 1 end as p_value from tested),
ok as (
  select p.*, bool_and(p_value <= {control.delta!r} / (strata * {len(control.rules)})) over (
    partition by lang, rule order by step) as passed from p, strata),
chosen as (
  select lang, rule, arg_max(step, (caught - k) * 1000 - step) as step, max(caught - k) as gain from ok where passed
  group by lang, rule having max(caught - k) > 0),
failed as (
  select distinct r from hit join chosen on hit.lang is not distinct from chosen.lang and hit.rule = chosen.rule
    and hit.step = chosen.step where hit)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and r not in (select r from failed) as kept
from b
"""
