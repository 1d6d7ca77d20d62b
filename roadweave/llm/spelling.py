"""Spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded, stored

# The letters of a word, its least length and occurrences, and how much more frequent a form is.
LETTERS = r"[A-Za-zÀ-ÿ]"
LENGTH, OFTEN, TIMES = 6, 5, 5
#: Bigrams are broadcast up to this many (about 4 MB), beyond that they are joined by a shuffle.
BIGRAMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, text: str = "text", least: int = LENGTH) -> DataFrame:
    """doc_id and run: each longest run of letters of at least ``least`` in a text, A-Z in lower case."""
    # a run that is long enough matches whole from its first letter on; a shorter one not at all
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("run")
    )


def misspelt(runs: DataFrame, one_in: int = 199) -> DataFrame:
    """word: each run; where ``one_in`` divides h, the crc32 of "<doc_id>:<run>", without letter h % length (from 0).

    The id is written as a decimal number, a null id as nothing.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % one_in == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """word and n: the different words of enough letters and occurrences; counted before the shuffle."""
    return (
        words.filter(F.length("word") >= least)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= often)
    )


def pivots(prefix: Column) -> Column:
    """Places of the two disjoint bigrams of least total frequency, from structs (at, f) in order of place.

    Dynamic programming: ``one`` is the rarest bigram that lies two places or more in front
    of the next, ``two`` the best pair so far.
    """
    kind = "struct<f:long,at:int>"
    start = F.struct(
        F.lit(None).cast(kind).alias("one"),
        F.lit(None).cast(kind).alias("last"),
        F.lit(None).cast("struct<f:long,a:int,b:int>").alias("two"),
    )

    def step(acc: Column, x: Column) -> Column:
        behind = F.least(acc["one"], acc["last"])
        free = F.when(acc["last"]["at"] <= x["at"] - 2, behind).otherwise(acc["one"])
        pair = F.when(
            free.isNotNull(), F.struct((free["f"] + x["f"]).alias("f"), free["at"].alias("a"), x["at"].alias("b"))
        )
        return F.struct(
            behind.cast(kind).alias("one"),
            F.struct(x["f"].alias("f"), x["at"].alias("at")).cast(kind).alias("last"),
            F.least(acc["two"], pair).cast("struct<f:long,a:int,b:int>").alias("two"),
        )

    return F.aggregate(prefix, start, step, lambda acc: F.array(acc["two"]["a"], acc["two"]["b"]))


def grams(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with their gram prefix and pivots, as places of bigrams from 0.

    Bigrams are ordered by the number of words' places that hold them. The prefix is the
    three rarest of a word and all that rank equal to the third; among three places two are
    disjoint, so pivots exist.
    """
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    every = words.select("word", "n", at.alias("at", "gram"))
    # as many rows as the alphabet has pairs; a hot bigram is no single task's work then
    counts = stored(every.groupBy("gram").agg(F.count("*").alias("f")), "spelling-bigrams")
    ranked = (
        every.join(bounded(counts, BIGRAMS), "gram")
        .groupBy("word", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))).alias("g"))
    )
    third = F.get("g", F.lit(2))
    upto = F.filter("g", lambda x: F.struct(x["f"], x["gram"]) <= F.struct(third["f"], third["gram"]))
    prefix = F.sort_array(F.transform(upto, lambda x: F.struct(x["at"].alias("at"), x["f"].alias("f"))))
    return ranked.select("word", "n", prefix.alias("prefix")).select(
        "word", "n", F.transform("prefix", lambda x: x["at"]).alias("prefix"), pivots(F.col("prefix")).alias("pivots")
    )


def _side_keys(probe: bool) -> Column:
    """Keys of the gram at place ``at`` of ``word``: what is equal in a near word whose gram is left whole.

    The edit lies on one side of the gram; the other side and the gram agree. Of the l letters
    on the side of the edit, the first h or the last h agree too, h = floor(l / 2). l is that of
    the pivot's word; the other's may be one more or less, so it gives the keys of all l that
    can be meant. Places are fixed by the key: from the front for an edit behind the gram,
    from the end for one in front.
    """
    word, at, n = F.col("word"), F.col("at"), F.length("word")

    def halves(letters: Column) -> Column:
        """Possible h for so many letters on the side of the edit."""
        own = F.floor(letters / 2).cast("int")
        if not probe:
            return F.array(own)
        near = [F.floor((letters + d) / 2).cast("int") for d in (-1, 0, 1)]
        return F.filter(F.array_distinct(F.array(*near)), lambda h: h >= 0)

    def key(kind: str, *parts: Column) -> Column:
        return F.xxhash64(F.lit(kind), *parts)

    cut = lambda start, length: F.substring(word, start, length)
    rest, none = n - at - 2, F.lit(None).cast("long")
    behind = lambda h: F.array(
        key("behind, first", at, h, cut(F.lit(1), at + 2 + h)),
        F.when(h > 0, key("behind, last", h, cut(F.lit(1), at + 2), cut(n - h + 1, h))).otherwise(none),
    )
    front = lambda h: F.array(
        key("front, first", h, cut(F.lit(1), h), cut(at + 1, n)),
        F.when(h > 0, key("front, last", h, cut(at - h + 1, n), n - at)).otherwise(none),
    )
    fits = lambda letters: lambda h: h <= letters
    return F.flatten(
        F.concat(
            F.transform(F.filter(halves(rest), fits(rest)), behind), F.transform(F.filter(halves(at), fits(at)), front)
        )
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all ordered pairs of words of ``words`` (word, n) that are one edit apart.

    One edit leaves one of two disjoint bigrams whole. Of two near words, the pivot of the one
    whose prefix ends earlier that is left whole is thus in the prefix of the other, for that
    holds all bigrams up to its own last. So pivots meet the prefix grams whose place and
    surroundings allow a single edit, see ``_side_keys``; what meets is verified. Needs words
    of six letters or more. Both sides hold several keys a word, which Spark does not see in
    the size of the words' table, so the join is fixed to a shuffle.
    """
    held = stored(grams(words), "spelling-grams")

    def keyed(column: str, name: str, probe: bool) -> DataFrame:
        rows = held.select("word", "n", F.explode(column).alias("at"))
        keys = rows.select(F.explode(_side_keys(probe)).alias("key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
        return keys.where("key is not null")

    met = (
        keyed("pivots", "a", False)
        .join(keyed("prefix", "b", True).hint("merge"), "key")
        .filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b")))
        .filter(F.levenshtein("a", "b", 1) == 1)
        .drop("key")
    )
    back = met.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return met.unionByName(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of each chain of forms, by doubling the step."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        again = stored(now.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = again.drop("moved")
        if not again.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near
    word of largest n (ties: the smallest in code-point order) if that is ``times`` its own n
    or more, else null; root follows forms to the last (the word itself without a form). As n
    grows at each step, chains are short and have no circles. Words are different and not
    null, as ``vocabulary`` gives them; an empty table gives an empty one. Nothing that grows
    with the words is broadcast: stored words are several times larger in memory.
    """
    held = stored(words.select("word", "n"), "spelling-words")
    near = near_pairs(held).groupBy("a", "n_a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("b"))).alias("top")
    )
    enough = -F.col("top.less") >= times * F.col("n_a")
    near = stored(
        near.select(
            F.col("a").alias("word"),
            "n_near",
            F.when(enough, F.col("top.b")).alias("form"),
            F.when(enough, -F.col("top.less")).alias("form_n"),
        ),
        "spelling-near",
    )
    last = roots(near.filter("form is not null").select("word", "form"))
    return (
        held.join(near.hint("merge"), "word", "left")
        .join(last.hint("merge"), "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


#: The same by deletions: equal without one letter at the same place, or equal to the other without one letter.
ORACLE = r"""
with recursive crc as (
  select i, i::ubigint as c, 0 as k from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from crc where k < 8),
codes as (select list(c order by i) as cs from crc where k = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as run from documents),
each_run as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by all),
bytes as (
  select doc_id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from each_run),
hashed as (
  select doc_id, run, n, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
    list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::ubigint)),
    lambda c, b: xor(cs[(xor(c, b) & 255)::int + 1], c >> 8))) as h
  from bytes, codes),
words as (
  select case when h % 199 = 0 then run[1 : (h % length(run))::bigint] || run[(h % length(run))::bigint + 2 :] else run end
    as word, sum(n)::bigint as n from hashed group by 1 having length(word) >= 6 and sum(n) >= 5),
cut as (
  select word, n, unnest(range(1, length(word) + 1)) as i from words),
less as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from cut),
pairs as (
  select x.word as a, x.n as n_a, y.word as b, y.n as n_b from less x join less y using (i, rest) where x.word <> y.word
  union
  select x.word, x.n, y.word, y.n from less x join words y on x.rest = y.word
  union
  select y.word, y.n, x.word, x.n from less x join words y on x.rest = y.word),
near as (
  select a, n_a, count(*) as n_near, max(n_b) as top, min(b) filter (n_b = m) as best
  from (select *, max(n_b) over (partition by a) as m from pairs) group by a, n_a),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then best end as form,
    case when top >= 5 * n then top end as form_n
  from words left join near on word = a),
follow as (
  select word, word as last, form as onto from forms
  union all
  select f.word, g.word, g.form from follow f join forms g on f.onto = g.word)
select forms.word, form, last as root, n, n_near::bigint as n_near, form_n
from forms join follow on forms.word = follow.word and onto is null
"""
