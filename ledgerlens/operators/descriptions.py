"""Free-text descriptions to procedure codes: exact, fuzzy, substring and word matches from one set of candidates.

Dictionary and rate descriptions form one inverted index: whole texts, words, and substrings of two and three letters; of rows
with equal text it holds the few that a step can return. Names alike in what decides a step ask one question, and a question asks
for a few keys only, tagged with the step they serve, in one join (for the dictionary, then for rate descriptions):

* exact: its whole text;
* fuzzy: words. Two sets of words that share 0.7 of the smaller one also share one of that one's rarest words, as many as
  0.3 of it and one more; so a name's rarest words meet all words of entries, and its words meet the entries' rarest;
* inside: its rarest substring of three letters;
* words: the rarest such substring of its first two longer words.

What is found is tested, the best few per step stay, and the first step with a result gives the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams, normal_text, overlap, round_to, tokens

INSIDE, WORDS, FINAL, FUZZY = 0.85, 0.5, 0.6, 0.7
FIRST_ROWS = 5
STEPS = ("exact", "fuzzy", "inside", "words")


def searchable(clfs: DataFrame, asp: DataFrame, opps: DataFrame) -> DataFrame:
    """Rate descriptions in source order: laboratory short and long, drugs, outpatient."""
    parts = [(clfs, "short_desc"), (clfs, "long_desc"), (asp, "short_desc"), (opps, "short_desc")]
    out = None
    for k, (d, c) in enumerate(parts):
        one = d.where(F.col(c).isNotNull()).select(F.lit(k).alias("ord"), F.col("rate_seq").alias("seq"), "code", F.col(c).alias("said"))
        out = one if out is None else out.unionByName(one)
    return out


def _first_rows(texts: DataFrame) -> DataFrame:
    """Of rows with equal text and source the first ones, all that a step can return: the index grows with the texts that differ."""
    near = Window.partitionBy("entry", F.when(F.col("entry"), F.lit(-1)).otherwise(F.col("ord")), "text").orderBy("ord", "seq")
    return texts.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= FIRST_ROWS).where((F.col("nth") == 1) | ~F.col("entry")).drop("nth")


def _entries(synonyms: DataFrame) -> DataFrame:
    return synonyms.select(F.lit(True).alias("entry"), F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("seq"), "code", normal_text("description").alias("text"))


def entries(synonyms: DataFrame) -> DataFrame:
    """The part of ``dictionary`` that exact and fuzzy matches read."""
    return _first_rows(_entries(synonyms))


def dictionary(synonyms: DataFrame, said: DataFrame) -> DataFrame:
    """(entry, ord, seq, code, text): both sources of codes, as the index reads them. Best stored, as it is read a few times."""
    return _first_rows(_entries(synonyms).unionByName(said.select(F.lit(False).alias("entry"), F.col("ord").cast("long").alias("ord"), F.col("seq").cast("long").alias("seq"), "code", F.lower("said").alias("text"))))


def _prefixed(prefix: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(prefix), w))


def _rarest(keyed: Column, size: Column) -> Column:
    """Of (n, key) pairs the rarest that a set sharing FUZZY of ``size`` words can't all miss; words without a pair are rarer still."""
    most = size - F.ceil(size * FUZZY - 1e-9) + 1 - (size - F.size(keyed))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.greatest(most, F.lit(0)).cast("int")), lambda x: x["key"])


def _index(texts: DataFrame, steps: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (key, ord, seq, code, text) that ``steps`` may ask for, and (key, n): how often words and substrings occur there."""
    entries, said = {"exact", "fuzzy"} & {*steps}, {"inside", "words"} & {*steps}
    texts = texts.where(F.col("entry") == bool(entries)) if bool(entries) != bool(said) else texts
    words, whole = _prefixed("a", F.split("text", " ")), F.array(F.concat(F.lit("="), "text"))
    pieces = _prefixed("g", F.concat(grams("text", 2), grams("text", 3)))
    keys = F.when(F.col("entry"), F.concat(whole, F.array_distinct(words))).otherwise(pieces) if said else F.concat(whole, F.array_distinct(words))
    rows = texts.select(F.explode(pieces if not entries else keys).alias("key"), "ord", "seq", "code", "text")
    often = rows.where("NOT startswith(key, '=')").groupBy("key").agg(F.count("*").alias("n"))
    if "fuzzy" in steps:
        each = texts.where("entry").select("ord", "code", "text", F.explode(F.array_distinct(words)).alias("key")).join(often, "key")
        few = each.groupBy("ord", "code", "text").agg(F.collect_list(F.struct("n", "key")).alias("k"))
        few = few.select(F.explode(_prefixed("b", F.transform(_rarest(F.col("k"), F.size("k")), lambda x: F.substring(x, 2, 1 << 30)))).alias("key"), "ord", F.lit(0).cast("long").alias("seq"), "code", "text")
        rows = rows.unionByName(few)
    return rows, often


def _longer(words: Column) -> Column:
    return F.filter(words, lambda x: F.length(x) > 2)


def _questions(names: DataFrame, often: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """(name, step, question, size): what decides a step's result, so that names alike in it ask once.

    Exact and inside ask for the name, words for its first two longer words, fuzzy for its words that entries know, ``size``
    being the number of all its words.
    """
    t = F.array_distinct(F.split("name", " "))  # names and entries are normal texts
    longer = _longer(t)
    asks = {"exact": F.col("name"), "inside": F.col("name"), "words": F.when(F.size(longer) >= 2, F.concat_ws(" ", F.get(longer, F.lit(0)), F.get(longer, F.lit(1))))}
    plain = [F.struct(F.lit(s).alias("step"), asks[s].alias("question"), F.lit(0).alias("size")) for s in steps if s in asks]
    parts = [names.select("name", F.explode(F.array(*plain)).alias("q")).select("name", "q.*").where("question IS NOT NULL")] if plain else []
    if "fuzzy" in steps:
        words = names.select("name", F.size(t).alias("size"), F.explode(_prefixed("a", t)).alias("key")).join(often.select("key"), "key")
        parts.append(words.groupBy("name", "size").agg(F.array_join(F.sort_array(F.collect_list(F.substring("key", 2, 1 << 30))), " ").alias("question")).select("name", F.lit("fuzzy").alias("step"), "question", "size"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _asked(questions: DataFrame, often: DataFrame) -> DataFrame:
    """(step, question, size, key): what each question asks the index for."""
    t, is_ = F.split("question", " "), lambda s: F.col("step") == s
    own = F.when(F.length("question") > 2, grams("question", 3)).otherwise(F.array("question"))
    two = F.array_distinct(F.concat(grams(F.get(t, F.lit(0)), 3), grams(F.get(t, F.lit(1)), 3)))
    wanted = F.when(is_("fuzzy"), _prefixed("a", t)).when(is_("inside"), _prefixed("g", own)).when(is_("words"), _prefixed("g", two)).otherwise(F.array(F.concat(F.lit("="), "question")))
    counted = questions.select("step", "question", "size", F.explode(wanted).alias("key")).join(often, "key", "left")
    by = counted.groupBy("step", "question", "size").agg(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    #: a substring that no description holds rules the step out
    one = F.filter(F.array(F.array_min("k")), lambda x: x["n"] > 0)["key"]
    keys = F.when(is_("fuzzy"), F.concat(_rarest(F.col("k"), F.col("size")), _prefixed("b", t))).when(is_("exact"), F.col("k")["key"]).otherwise(one)
    return by.select("step", "question", "size", F.explode(keys).alias("key"))


def match(names: DataFrame, texts: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(name, code, confidence, step) of the first of ``steps`` with a result (J20 to J24), from a ``dictionary``.

    ``names`` are distinct normal texts of 2 letters or more.

    * exact: equal text, the first entry; confidence 1;
    * fuzzy: the largest share of common words in the smaller set, 0.7 at least, the first entry on ties;
    * inside: the first description by source and row that holds the name; confidence 0.85;
    * words: descriptions that hold the first two longer words; of each source the first five are scored by common words,
      the first source with 0.5 or more decides; confidence is 0.9 of the score, at most 0.8.
    """
    rows, often = _index(texts, steps)
    questions = _questions(names, often, steps)
    c = _asked(questions.select("step", "question", "size").distinct(), often).join(rows, "key")
    t, st = F.split("question", " "), F.array_distinct(F.split("text", " "))
    is_ = lambda s: F.col("step") == s
    held = F.when(is_("inside"), F.contains("text", F.col("question"))).when(is_("words"), F.contains("text", F.get(t, F.lit(0))) & F.contains("text", F.get(t, F.lit(1)))).otherwise(True)
    score = F.size(F.array_intersect(t, st)) / F.least(F.col("size"), F.size(st))
    c = c.where(held).withColumn("score", F.when(is_("fuzzy"), score)).where(~is_("fuzzy") | (F.col("score") >= FUZZY))
    # of an entry's several keys any one will do: ties have equal scores and entries
    c = c.withColumns({"group": F.when(is_("words"), F.col("ord")).otherwise(-1), "o1": F.when(is_("fuzzy"), -F.col("score")).when(is_("inside"), F.col("ord").cast("double")).otherwise(0.0), "o2": F.when(is_("inside") | is_("words"), F.col("seq")).otherwise(F.col("ord"))})
    near = Window.partitionBy("step", "question", "size", "group").orderBy("o1", "o2")
    c = c.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= FIRST_ROWS).where(is_("words") | (F.col("rank") == 1))
    c = questions.join(c.withColumn("said", F.when(is_("words"), tokens("text"))).drop("text"), ["step", "question", "size"])
    c = c.withColumn("score", F.when(is_("words"), overlap(F.array_distinct(F.split("name", " ")), F.col("said"))).otherwise(F.col("score"))).where(~is_("words") | (F.col("score") >= WORDS))
    confidence = F.when(is_("exact"), 1.0).when(is_("fuzzy"), F.col("score")).when(is_("inside"), INSIDE).otherwise(round_to(F.least(F.col("score") * 0.9, F.lit(0.8)), 2))
    place = F.when(is_("words"), F.struct(F.col("ord").cast("double").alias("a"), (-F.col("score")).alias("b"), F.col("seq").alias("c"))).otherwise(F.struct(F.col("o1").alias("a"), F.lit(0.0).alias("b"), F.col("o2").alias("c")))
    order = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(STEPS) for x in (s, k)]), F.col("step"))
    best = c.groupBy("name").agg(F.min(F.struct(order.alias("k"), place.alias("p"), "code", confidence.alias("confidence"), "step")).alias("b"))
    return best.select("name", "b.code", "b.confidence", "b.step")


def resolve(descriptions: DataFrame, texts: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """(description, code, confidence, step): the cascade on distinct normal texts (J24); results below 0.6 are dropped at the end.

    Substrings are looked for only where the dictionary gave nothing. ``keep`` may store what is read twice, by a name.
    """
    d = descriptions.select("description").distinct().withColumn("name", normal_text("description"))
    names = keep("names", d.where(F.length("name") >= 2).select("name").distinct())
    first = keep("named", match(names, texts, ("exact", "fuzzy")))
    found = first.unionByName(match(names.join(first, "name", "left_anti"), texts, ("inside", "words")))
    return d.join(found.where(F.col("confidence") >= FINAL), "name").select("description", "code", "confidence", "step")
