"""Grouping of spelling variants: one-edit pairs of words by merging the light subtrees of their trie.

The words form a trie whose nodes are their prefixes; the end of a word is an edge of its own ("" here).
At each node the edge with the most words below it is heavy (ties to the larger character), all others
are light, so a word has at most log2(words) light edges on its way. Two words one edit apart part at one
node, and at most one of the two goes on by the heavy edge there. So at each node only the words of light
subtrees are moved, small to large:

* replaced: the first character of the light subtree becomes the heavy one; where the moved word coincides
  with a word of the heavy subtree, the two are a pair;
* skipped: it is left out, and the rest coincides with a word below the node;
* preceded by the heavy character: the moved word coincides with one of the heavy subtree that has one
  character more;
* two light subtrees at a node are merged with each other by what follows their first characters.

A run of one character could lose any of its characters to the same effect; the rule takes the last, at
which the two words really part, so each pair is found once. The trie is a table of edges, counted by
prefix before it is shuffled; words meet their light edges and the moved words meet the words in joins.
Prefixes over which a large share of the words stand are broadcast (common.join_hot). A group of light
words that coincide has at most one word for each character of the alphabet, and each of its pairs is a
result. Only the number of roots that still move, and the sizes of join_hot, reach the driver.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one; rows that
repeat a document count again; the two words of a pair with equal n are near but neither is the other's
form; an empty table gives an empty table. Very long texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_hot, materialize, release_since, scratch_mark

#: Fixed values of the contract: which runs lose a character, and which words count.
EVERY, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


def _from(text: Column, at: Column) -> Column:
    """text from a place (from 0) on."""
    return F.substring(text, at + F.lit(1), F.char_length(text))


def counted_words(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text): lower-cased letter runs, those that a digest of the document and
    the run picks without one character, of at least least_length code points and least_count occurrences."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    rows = rows.filter(F.char_length("run") >= least_length)  # no run grows
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), _from(F.col("run"), at + 1))
    rows = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, at, node, c, heavy) for the light edges on each word's way: the prefix `node` of length
    `at` is left by the character c ("" at the word's end), while most words leave it by `heavy`."""
    w, at = F.col("word"), F.col("at")
    ways = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    ways = ways.select("word", "n", "at", F.substring(w, F.lit(1), at).alias("node"), F.substring(w, at + F.lit(1), F.lit(1)).alias("c"))
    edges = ways.groupBy("node", "c").agg(F.count(F.lit(1)).alias("below"))
    nodes = edges.groupBy("node").agg(F.max(F.struct("below", "c")).alias("most"), F.sum("below").alias("below"), F.count(F.lit(1)).alias("ways"))
    nodes = nodes.filter("ways > 1").select("node", F.col("most.c").alias("heavy"), "below")
    return join_hot(ways, nodes, ["node"], "below").filter("c <> heavy").select("word", "n", "at", "node", "c", "heavy")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each two of words (word, n; no word twice) that differ by exactly one inserted, deleted
    or replaced character, once."""
    light = materialize(light_edges(words))
    rest, after = _from(F.col("word"), F.col("at") + 1), _from(F.col("word"), F.col("at"))
    inner = F.col("c") != ""
    replaced = F.when(inner, F.concat("node", "heavy", rest))
    skipped = F.when(inner & (F.substring(rest, 1, 1) != F.col("c")), F.concat("node", rest))
    preceded = F.concat("node", "heavy", after)
    moved = light.select("word", "n", F.explode(F.array_compact(F.array(replaced, skipped, preceded))).alias("to"))
    met = moved.join(words.select(F.col("word").alias("to"), F.col("n").alias("n_to")), "to")
    out = met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("to").alias("b"), F.col("n_to").alias("n_b"))

    merged = light.filter(inner).groupBy("node", rest.alias("rest")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("l")).filter("size(l) > 1")
    two = merged.select("l", F.posexplode("l").alias("i", "x")).select("x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))
    return out.unionByName(two.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles: root is the last form that follows. The ways
    halve with each round; every round is written to the shared folder and the one before removed."""
    spark, mark = links.sparkSession, scratch_mark()
    tops = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = tops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if tops.join(on, "root", "left_semi").isEmpty():
            return tops
        tops = materialize(tops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        release_since(spark, mark, keep=1)


def groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = materialize(words)
    pairs = near_pairs(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best")
    found = words.join(sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    tops = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    return groups(counted_words(docs))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
crc AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM per, tab),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM crc GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
v AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (
  SELECT DISTINCT x.word, y.word AS other, y.n AS m FROM v x JOIN v y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.cut = w.word),
g AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS best FROM e GROUP BY word),
f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.other END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n
  FROM w LEFT JOIN g USING (word)),
up AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, top.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word) top ON top.word = f.word
"""
