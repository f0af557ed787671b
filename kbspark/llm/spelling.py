"""Spelling variants of a vocabulary by a relational walk over its trie.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  The trie of the words is an
edge table (``edges``): a row for every edge out of a prefix that two words share, with what is below the child.  The walk
starts every word at the root and joins the frontier of states ``(word, pos, node, edits)`` with the edge table level by
level: the next character is matched (no edit), or once replaced, inserted or deleted; after that only matches are left.
States that reach the word's end with one edit on the end of another word make the two words neighbours.

What is below a child decides early: the lengths of what is left, a mask of its hashes and the characters that follow
drop states that cannot end, and below a child with one word its remaining characters are compared at once.  So the walk
has as many levels as the longest prefix that two words share has characters.

A word's ``form`` is its near word of largest ``n`` (ties: the smallest in code-point order) if that n is at least
``ratio`` times the word's own; ``root`` follows forms to the last, by pointer doubling (n grows on every step, so there
are no cycles).

Scale: the vocabulary is aggregated before anything is shuffled.  A node has at most as many edges as there are
characters.  All words stand on the root and many on the nodes below, so nodes are salted by their depth and by the words
below them: a (node, salt) pair has a bounded share of the states.  Every level is written to the shared checkpoint folder
and read from there.

Defined results: an empty vocabulary gives an empty result; null words are left out; repeated words count once, with the
sum of their n; a word without near words has no form and is its own root.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir

_ENDS = 62  # lengths from here on share a bit
_PARTS = 4  # of a mask, 64 bits each
_MASKS = [f"m{k}" for k in range(_PARTS)]


@dataclass(frozen=True)
class VariantParams:
    ratio: int = 5             # how many times a form is as frequent as its variant
    states: int = 20_000       # words that share a (node, salt) pair
    fan: int = 4               # by how much a level spreads the words at least


def vocabulary(words: DataFrame, least_chars: int = 6, least_n: int = 5, word: str = "word") -> DataFrame:
    """``word, n`` of all words with so many code points and occurrences."""
    return (words.filter(F.char_length(word) >= least_chars).groupBy(F.col(word).alias("word"))
            .agg(F.count("*").alias("n")).filter(F.col("n") >= least_n))


def _bit(number) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _mask(left: Column, k: int) -> Column:
    """The bit of a remainder in the k-th part of a node's mask."""
    h = F.pmod(F.xxhash64(left), F.lit(64 * _PARTS))
    return F.when(F.floor(h / 64) == k, _bit(h % 64)).otherwise(F.lit(0).cast("long"))


def edges(words: DataFrame, p: VariantParams) -> DataFrame:
    """The trie, a row ``node, salt, ch, ...`` for every edge out of a prefix of two words or more and every salt of it.

    Of the child: the lengths of what its words have left (``lens``, bits), their next characters (``next``), a mask of
    their hashes (``m0`` ...), their number, its salts and, for one word, what is left of it (``tail``).
    """
    total = words.count()
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("depth"))
    left = F.col("left")
    nodes = (at.select(F.expr("substring(word, 1, depth)").alias("node"), "depth",
                       F.expr("substring(word, depth + 1)").alias("left"))
             .groupBy("node", "depth")
             .agg(F.count("*").alias("words"),
                  F.bit_or(_bit(F.least(F.char_length("left"), F.lit(_ENDS)))).alias("lens"),
                  F.concat_ws("", F.sort_array(F.collect_set(F.expr("nullif(substring(left, 1, 1), '')")))).alias("next"),
                  *[F.bit_or(_mask(left, k)).alias(f"m{k}") for k in range(_PARTS)],
                  F.max("left").alias("left")))
    spread = F.ceil(F.lit(float(total)) / p.states / F.pow(F.lit(float(p.fan)), "depth"))
    nodes = nodes.withColumn("salts", F.greatest(F.lit(1), spread, F.ceil(F.col("words") / p.states)).cast("int"))
    own = nodes.filter("words > 1").select("node", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    return (nodes.filter("depth > 0")
            .select(F.expr("substring(node, 1, depth - 1)").alias("node"), F.expr("right(node, 1)").alias("ch"), "lens",
                    "next", *_MASKS, "salts", F.expr("if(words = 1, left, null)").alias("tail"))
            .join(own, "node"))


def _reaches(rest: str, lens: str = "lens", next_: str = "next", masks: str = "m") -> str:
    """SQL: may one of a node's words have exactly ``rest`` left?"""
    part = " ".join(f"WHEN {k} THEN {masks}{k}" for k in range(_PARTS))
    h = f"pmod(xxhash64({rest}), {64 * _PARTS})"
    return (f"((shiftright({lens}, least(char_length({rest}), {_ENDS})) & 1) = 1 AND instr({next_}, substring({rest}, 1, 1)) > 0"
            f" AND (shiftright(CASE {h} div 64 {part} END, cast({h} % 64 AS int)) & 1) = 1)")


def _advance(frontier: DataFrame, trie: DataFrame) -> DataFrame:
    """The next states and the neighbours found (``near``) of a frontier.

    One join with the edges of a state's node; a state that has used its edit meets one edge only.
    """
    f = (frontier.withColumn("left", F.expr("substring(word, pos + 1)"))
         .withColumn("c", F.expr("substring(left, 1, 1)")).withColumn("rest", F.expr("substring(left, 2)")))
    mine = f.select("node", "salt", "word", "pos", "edits", "left", "c", "rest")
    e = trie.select(F.col("node").alias("at"), F.col("salt").alias("s"), "ch", "lens", "next", *_MASKS, "salts", "tail")
    here = mine.join(e, (F.col("node") == F.col("at")) & (F.col("salt") == F.col("s"))
                     & ((F.col("edits") == 0) | (F.col("ch") == F.col("c"))))
    # On along an edge: the character is matched or replaced (the word moves on too), or inserted (it does not).
    moves = here.select("word", "pos", "node", "edits", "ch", "c", "lens", "next", *_MASKS, "salts", "tail", F.explode(F.expr(
        "if(edits = 0, array(struct(true as on, rest as rest), struct(false as on, left as rest)), "
        "array(struct(true as on, rest as rest)))")).alias("m"))
    same = "m.on and ch = c"
    moves = (moves.filter("not m.on or c <> ''")
             .selectExpr("word", "if(m.on, pos + 1, pos) AS pos", "concat(node, ch) AS node", "lens", "next", *_MASKS,
                         "salts", "tail", "m.rest AS rest", f"if(edits = 0 and {same}, 0, 1) AS edits")
             .selectExpr("*", "edits = 1 and if(tail is not null, tail = rest, rest = '' and (lens & 1) = 1) AS ends",
                         f"tail is null and (edits = 0 or (rest <> '' and {_reaches('rest')})) AS live"))
    # A character of the word deleted: the node stays.
    masks = [f"m{k}" for k in range(_PARTS)]
    dropped = (f.filter("edits = 0 and c <> ''").selectExpr(
        "word", "pos + 1 AS pos", "node", "lens", "next", *masks, "salts", "cast(null as string) AS tail", "rest", "1 AS edits")
        .selectExpr("*", "rest = '' and (lens & 1) = 1 AS ends", f"rest <> '' and {_reaches('rest')} AS live"))
    kept = [f"if(edits = 0, {c}, null) AS {c}" for c in ("lens", "next", *_MASKS, "salts")]
    return (moves.unionByName(dropped).filter("ends or live")
            .selectExpr("word", "pos", "node", "edits", "cast(pmod(xxhash64(word), salts) as int) AS salt", *kept, "live",
                        "if(ends, concat(node, coalesce(tail, '')), null) AS near"))


def neighbours(words: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """Distinct pairs ``word, near`` (both directions) of distinct words that are one edit apart."""
    spark = words.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    edges(words, p).write.parquet(f"{folder}/edges")
    trie = spark.read.parquet(f"{folder}/edges")
    depth = trie.agg(F.max(F.char_length("node"))).first()[0]
    # All words on the root (the root itself has the lengths and first characters of all; its mask is full).
    size = F.char_length("word")
    root = words.agg(F.bit_or(_bit(F.least(size, F.lit(_ENDS)))).alias("lens"),
                     F.concat_ws("", F.collect_set(F.substring("word", 1, 1))).alias("next"),
                     *[F.bit_or(_mask(F.col("word"), k)).alias(f"m{k}") for k in range(_PARTS)]).first()
    salts = trie.filter("node = ''").agg(F.max("salt")).first()[0]
    frontier = words.select(
        "word", F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits"),
        F.pmod(F.xxhash64("word"), F.lit((salts or 0) + 1)).cast("int").alias("salt"),
        *[F.lit(root[c]).alias(c) for c in ("lens", "next", *_MASKS)], F.lit((salts or 0) + 1).alias("salts"))
    level, levels = 0, 0 if depth is None else depth + 2
    while level < levels:
        path = f"{folder}/level-{level}"
        _advance(frontier, trie).write.parquet(path)
        got = spark.read.parquet(path)
        frontier = got.filter("live").drop("live", "near")
        level += 1
        if frontier.isEmpty():
            break
    if not level:
        return words.select("word", F.col("word").alias("near")).limit(0)
    found = spark.read.parquet(*[f"{folder}/level-{i}" for i in range(level)])
    return found.filter("near IS NOT NULL").select("word", "near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form."""
    to = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("then"))
        further = to.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"), "then").checkpoint()
        to = further.select("word", "root")
        if further.filter("then IS NOT NULL").isEmpty():
            return to


def group(vocab: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every distinct word of a table ``word, n``."""
    words = (vocab.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
             .checkpoint())
    pairs = neighbours(words.select("word"), p)
    best = (pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"),
                                 F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("b")))
    known = (words.join(best, "word", "left")
             .withColumn("ok", F.coalesce(-F.col("b.down") >= p.ratio * F.col("n"), F.lit(False)))
             .select("word", F.when(F.col("ok"), F.col("b.near")).alias("form"), "n",
                     F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                     F.when(F.col("ok"), -F.col("b.down")).alias("form_n")).checkpoint())
    roots = _roots(known.filter("form IS NOT NULL").select("word", "form"))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
