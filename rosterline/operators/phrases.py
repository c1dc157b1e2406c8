"""Fuzzy dictionary phrases of a whole batch: a similarity join that scores every distinct phrase once.

The scans of :mod:`entities` score each phrase where it stands.  A batch holds
the same phrases many times over, so here its distinct phrases meet the names
they may resemble over shared letter pairs, are scored exactly, and go back to
the messages by an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.frames import explode_rows, spread
from ..functions.sql import let, rows
from ..vocab import specialties as sp
from . import entities

#: most phrases that become a constant of the plan
KNOWN = 1000

#: keys of names and phrases too short for a shared letter pair
_SHORT_NAME, _SHORT_PHRASE = "", "*"


def names_table(spark, names: list[str]) -> DataFrame:
    """``label``, ``text`` (lower case), ``ord`` of a dictionary's names."""
    table = rows("label:string,text:string,ord:int", [(n, n.lower(), i) for i, n in enumerate(names)])
    return spark.range(1).selectExpr(f"inline({table})")


def letter_pairs(text: str) -> str:
    """Array of the neighbouring letters of a text, repeats included."""
    return let(f"split({text}, '')", "cs", "if(size(cs) > 1, transform(sequence(0, size(cs) - 2), i -> concat(get(cs, i), get(cs, i + 1))), cast(array() as array<string>))")


def spoiled(length: str, threshold: float) -> str:
    """Most letter pairs of a phrase that edits within the threshold can break.

    With u = 1 - threshold, x letters lost and y gained keep the similarity of a
    phrase of m letters only while ``(1 + u) x + (1 - u) y <= 2 u m``; a lost
    letter breaks two pairs, a gained one breaks one.
    """
    u = 1 - threshold / 100
    return f"cast(floor({max(4 * u / (1 + u), 2 * u / (1 - u))!r}D * {length} + 1e-9D) as int)"


def _index(names: DataFrame, threshold: float) -> DataFrame:
    """``pair``, ``ord``, ``len``, ``always``: letter pairs under which a name is found.

    Of the leading pairs of a name, one more than edits can break, a phrase at
    least as long as the name holds one (``always``); a shorter phrase may match
    any stretch of the name and is looked up under all pairs.
    """
    entry = "transform(ps, (p, i) -> named_struct('pair', p, 'always', i <= most))"
    short = f"if(size(ps) <= most, array(named_struct('pair', '{_SHORT_NAME}', 'always', true)), cast(array() as array<struct<pair:string,always:boolean>>))"
    every = f"array(named_struct('pair', '{_SHORT_PHRASE}', 'always', true))"
    keys = let(letter_pairs("text"), "ps", let(spoiled("length(text)", threshold), "most", f"concat({entry}, {short}, {every})"))
    return names.select("ord", F.length("text").alias("len"), F.explode(F.expr(keys)).alias("k")).select("k.pair", "ord", "len", "k.always")


def similar_names(phrases: DataFrame, names: DataFrame, ratio: float = entities.FUZZY_RATIO, partial: float = entities.FUZZY_PARTIAL,
                  longest: int = similarity.WORD) -> DataFrame:
    """``phrase``, ``label``, ``score``: the best name of every phrase that has one.

    ``phrases`` has one column ``phrase`` (lower case, repeats allowed), ``names``
    the columns ``label``, ``text`` (lower case) and ``ord``; ``longest`` is the
    length of the longest name.  The best whole similarity of ``ratio`` or more
    wins, else the best partial one of ``partial`` or more; equal scores go to
    the smaller ``ord``.  Nothing similar enough is missed: see :func:`_index`.
    Null phrases and names match nothing.
    """
    least = min(ratio, partial)
    names = names.filter("text <> ''")
    short = f"length(phrase) - 1 <= {spoiled('length(phrase)', least)}"
    keys = f"if({short}, array('{_SHORT_PHRASE}'), array_union(array('{_SHORT_NAME}'), {letter_pairs('phrase')}))"
    distinct = phrases.filter("phrase <> ''").select("phrase").distinct().transform(spread, "phrase")
    met = (
        distinct.select("phrase", F.explode(F.expr(keys)).alias("pair")).join(_index(names, least), "pair")
        .filter("always OR length(phrase) < len").groupBy("phrase").agg(F.collect_set("ord").alias("ords"))
    )
    patterns = names.select("ord", F.struct(
        "label", "text", F.length("text").alias("len"), F.expr(similarity.full_bits("text")).alias("full"), F.expr(similarity.letter_masks("text")).alias("masks"),
        F.expr(similarity.whole_pieces("text", partial)).alias("pieces"), "ord",
        F.expr(letter_pairs("text")).alias("pairs")).alias("p"))
    gathered = met.select("phrase", F.explode("ords").alias("ord")).join(patterns, "ord").groupBy("phrase").agg(F.collect_list("p").alias("ps"))
    # edits within the threshold leave the shorter side most of its letter pairs
    whole = f"least(length(phrase), p.len) >= {ratio / (200 - ratio)!r}D * greatest(length(phrase), p.len) - 1e-9D"

    def left(side, other, length):
        return f"size(array_except({side}, {other})) <= if({whole}, {spoiled(length, least)}, {spoiled(length, partial)})"

    near = f"filter(ps, p -> if(length(phrase) >= p.len, {left('p.pairs', 'own', 'p.len')}, {left('own', 'p.pairs', 'length(phrase)')}))"
    gathered = gathered.select("phrase", F.expr(let(letter_pairs("phrase"), "own", near)).alias("ps"))
    best = f"coalesce({similarity.best_ratio('phrase', 'ps', ratio, longest)}, {similarity.best_partial_ratio('phrase', 'ps', partial, longest)})"
    return gathered.select("phrase", F.expr(best).alias("b")).filter("b IS NOT NULL").select("phrase", "b.label", "b.score")


def matched_phrases(texts: DataFrame, specialties=None, text: str = "text") -> DataFrame:
    """``phrase``, ``label``, ``score`` of the distinct phrases of a batch that resemble a specialty."""
    names = list(specialties or sp.SPECIALTIES)
    found = texts.transform(explode_rows, [], entities.specialty_phrases(text), "p").select(F.lower("p").alias("phrase"))
    return similar_names(found, names_table(texts.sparkSession, names), longest=max(map(len, names)))


def known_phrases(texts: DataFrame, specialties=None, text: str = "text", most: int = KNOWN) -> dict[str, tuple[str, float]] | None:
    """The matched phrases of a batch for :func:`entities.specialty_fuzzy`; None if they are more than ``most``.

    Runs a job.  Without them the scan scores each phrase in its row, with the same result.
    """
    got = matched_phrases(texts, specialties, text).limit(most + 1).collect()
    return None if len(got) > most else {r["phrase"]: (r["label"], r["score"]) for r in got}


def fuzzy_specialties(texts: DataFrame, keep: list[str], specialties=None, text: str = "text") -> DataFrame:
    """Rows of :func:`entities.specialty_fuzzy`, scored once per distinct phrase of the batch.

    Columns: ``keep``, ``row_id`` (one per input row, so that rows of equal keys
    stay apart), ``value``, ``confidence``, ``extractor_id``, ``ord``.
    """
    phrase = texts.withColumn("row_id", F.monotonically_increasing_id()).transform(
        explode_rows, [*keep, "row_id"], entities.specialty_phrases(text), "pos", "p").withColumn("phrase", F.lower("p"))
    hits = phrase.join(matched_phrases(texts, specialties, text), "phrase")
    first = hits.groupBy(*keep, "row_id", F.col("label").alias("value")).agg(F.min(F.struct("pos", "score")).alias("f"))
    order = Window.partitionBy("row_id").orderBy("f.pos")
    return first.select(
        *keep, "row_id", "value", F.expr(entities.fuzzy_confidence("f.score")).alias("confidence"), F.lit("fuzzy_match").alias("extractor_id"),
        (F.row_number().over(order) - 1).alias("ord"))


def specialties_of(texts: DataFrame, keep: list[str], specialties=None, text: str = "text") -> DataFrame:
    """Rows of :func:`entities.specialties_union`: all sources in order, the first hit per canonical name of an input row.

    Synonyms, codes and exact names come from the row, fuzzy phrases from the
    batch.  Columns: ``keep``, ``row_id``, ``value``, ``confidence``,
    ``extractor_id``, ``src`` and ``ord`` (source and place in it).
    """
    entry = "struct<src:int,ord:int,value:string,confidence:double,extractor_id:string,phrase:string>"
    sources = [(0, entities.specialty_synonyms), (1, entities.specialty_codes), (3, entities.specialty_exact)]
    hits = [f"transform({scan(text, specialties)}, h -> cast(struct({src}, h.ord, h.value, h.confidence, h.extractor_id, null) as {entry}))" for src, scan in sources]
    hits.append(f"transform({entities.specialty_phrases(text)}, (p, i) -> cast(struct(2, i, null, null, 'fuzzy_match', lower(p)) as {entry}))")
    found = texts.withColumn("row_id", F.monotonically_increasing_id()).transform(explode_rows, [*keep, "row_id"], f"concat({', '.join(hits)})", "h")
    matched = found.select(*keep, "row_id", "h.*").join(matched_phrases(texts, specialties, text), "phrase", "left").filter("src <> 2 OR label IS NOT NULL")
    ranked = matched.select(*keep, "row_id", F.coalesce("value", "label").alias("value"), F.struct(
        "src", "ord", F.coalesce("confidence", F.expr(entities.fuzzy_confidence("score"))).alias("confidence"), "extractor_id").alias("f"))
    first = ranked.groupBy(*keep, "row_id", "value").agg(F.min("f").alias("f"))
    return first.select(*keep, "row_id", "value", "f.confidence", "f.extractor_id", "f.src", "f.ord")
