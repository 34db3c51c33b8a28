"""Phrases from a weighted de Bruijn graph: its edges are the longest word sequences, the rest follows from their flow."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterflow.llm.tables import Workspace
from letterflow.llm.textcols import LOWER_AZ, U64, blocks, byte_values, mix, utf8, words

#: Words of an edge; a node is one word shorter.
LONGEST = 3
#: Least count of a phrase, and per cent of its count that make a longer phrase stand for it.
LEAST, COVERED = 10, 50
#: Phrases reported for a language.
TOP = 2000
#: Cuts are scored in millionths.
UNIT = 1_000_000
#: The language of rows without one.
UNKNOWN = "und"
#: Edges counted at once before they are shuffled.
FLUSH = 1 << 20
#: Words longer than so many bytes are hashed by a cryptographic digest.
LONG_WORD = 64
#: A pair of words that begins one in HOT edges is dealt out by the word after it as well, into SALTS parts.
HOT, SALTS = 2000, 64
#: Edges of a compacted path in one row; a longer path has several.
PATH_ROW = 4096
#: Rows that one task orders, and parts that a round of the ranking makes one.
RANKED, MERGED = 1 << 16, 32

#: What parts words, and what ends a piece.
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " \t.,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _GAP.copy()
_BREAK[[0x20, 0x09]] = False


def _digest(raw: bytes, seed: int) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little", signed=True) or 1


def tokens(raw: np.ndarray, at: np.ndarray, seed: int):
    """Of each word of a block: id, begin and end in bytes, and whether the word after it is in the same piece."""
    hashed, begin, end, first = words(raw, at, LOWER_AZ, _GAP, byte_values(seed))
    if not len(hashed):
        return np.zeros(0, np.int64), begin, end, np.zeros(0, bool), first
    own = hashed.copy()
    own[own == 0] = 1
    own = own.view(np.int64)
    for k in np.flatnonzero(end - begin > LONG_WORD):
        own[k] = _digest(LOWER_AZ[raw[begin[k]:end[k]]].tobytes(), seed)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    joined = np.zeros(len(own), bool)
    joined[:-1] = breaks[begin[1:]] == breaks[end[:-1]]
    ends = first[1:-1]
    joined[ends[(ends > 0) & (ends <= len(own))] - 1] = False
    return own, begin, end, joined, first


def _batch_langs(batch, seed: int) -> tuple[np.ndarray, list[str]]:
    names = [x if x is not None else UNKNOWN for x in batch.column("lang").to_pylist()]
    ids = {name: _digest(name.encode(), seed) for name in set(names)}
    return np.array([ids[x] for x in names], np.int64), names


def _windows(own: np.ndarray, joined: np.ndarray, longest: int) -> list[np.ndarray]:
    """The `longest` words from each word on, 0 after the end of its piece."""
    out, inside = [own], np.ones(len(own), bool)
    for k in range(1, longest):
        inside = inside & np.concatenate([joined, np.zeros(k, bool)])[k - 1:len(own) + k - 1]
        out.append(np.where(inside, np.concatenate([own[k:], np.zeros(k, np.int64)]), 0))
    return out


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), U64)
    for c in columns:
        out = mix(out ^ c.view(U64)) + U64(1)
    return out


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of the columns, those with a first value alike side by side, and how often each is there.

    Sorted by a digest, but told apart by the values: should two rows share one, some may be there twice.
    """
    near = columns[0].view(U64) & U64((1 << 64) - (1 << 40))
    order = np.argsort(near | (_mixed(columns) >> U64(24)))
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _surveyed(seed: int):
    def survey(batches):
        """The distinct words and languages of each batch by id, frequent pairs of its blocks, and its edges' number."""
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            langs, names = _batch_langs(batch, seed)
            known, texts, total = [], [], 0
            often = [[np.zeros(0, np.int64)] * 4]
            for a, b in blocks(at):
                own_raw, own_at = raw[at[a]:at[b]], at[a:b + 1] - at[a]
                own, begin, end, joined, first = tokens(own_raw, own_at, seed)
                if not len(own):
                    continue
                kinds, where = np.unique(own, return_index=True)
                known.append(kinds)
                texts += [LOWER_AZ[own_raw[begin[k]:end[k]]].tobytes().decode("utf-8", "replace") for k in where]
                total += len(own)
                pairs, n = _counted([np.repeat(langs[a:b], np.diff(first)), *_windows(own, joined, 2)])
                many = (n * 2 * HOT >= len(own)) & (pairs[2] != 0)
                often.append([*[c[many] for c in pairs], n[many]])
            every = np.concatenate([*known, np.zeros(0, np.int64)])
            every, where = np.unique(every, return_index=True)
            by_lang = dict(zip(langs.tolist(), names))
            ids = [*every.tolist(), *by_lang]
            values = [*[texts[k] for k in where], *by_lang.values()]
            *common, n = [np.concatenate(c) for c in zip(*often)]
            none = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids + [None] * (len(n) + 1), pa.int64()), pa.array(values + [None] * (len(n) + 1), pa.string()),
                *[pa.array([None] * none + c.tolist() + [None], pa.int64()) for c in common],
                pa.array([None] * none + n.tolist() + [total], pa.int64())],
                names=["id", "word", "lang", "w1", "w2", "n"])

    return survey


def _edges(seed: int, longest: int, hot: np.ndarray):
    columns = [f"w{k + 1}" for k in range(longest)]

    def counted(held):
        whole = [np.concatenate(c) for c in zip(*held)]
        keys, n = _counted([whole[1], whole[0], *whole[2:]])
        first, lang, *rest = keys
        salt = np.full(len(first), -1, np.int64)
        if len(hot) and longest > 2:
            own = np.isin(_mixed([lang, first, rest[0]]), hot)
            salt[own] = (mix(rest[1][own].view(U64)) % U64(SALTS)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (lang, salt, n, first, *rest)], names=["lang", "salt", "n", *columns])

    def edges(batches):
        """Counted edges: from every word of a text the words that follow in its piece, 0 after its end."""
        held, many = [], 0
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            langs, _ = _batch_langs(batch, seed)
            for a, b in blocks(at):
                own, _, _, joined, first = tokens(raw[at[a]:at[b]], at[a:b + 1] - at[a], seed)
                if len(own):
                    held.append([np.repeat(langs[a:b], np.diff(first)), *_windows(own, joined, longest)])
                    many += len(own)
                if many >= FLUSH:
                    yield counted(held)
                    held, many = [], 0
        if held:
            yield counted(held)

    return edges


def _flows(longest: int, least: int):
    """Counts of all phrases from the sorted edges of a partition.

    A phrase of k words occurs as often as the edges that begin with it, those that end with their
    piece before they have all words among them: the flow out of a node and its piece-end correction.
    Equal beginnings are neighbours, so every count is a sum over a run of rows. Single words and
    hot pairs may go on in other partitions and are summed again; the others are whole.
    """
    names = [f"w{k + 1}" for k in range(longest)]

    def flows(batches):
        before = None  # the last row's key
        held = [0] * longest  # sums of the runs still open, by length
        salt = -1

        def closed(k, keys, n, salts):
            keep = keys[k + 1] != 0
            if k == 1:
                keep = keep & ((n >= least) | (salts >= 0))
            elif k > 1:
                keep = keep & (n >= least)
            first, lang, *rest = [c[keep] for c in keys[:k + 2]]
            zero = np.zeros(int(keep.sum()), np.int64)
            return [lang, n[keep], first, *rest, *[zero] * (longest - 1 - k)]

        def batch_of(parts):
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "n", *names])

        for batch in batches:
            if not len(batch):
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            n, salts = get("n"), get("salt")
            keys = [get("w1"), get("lang"), *[get(c) for c in names[1:]]]
            if before is None:
                before, salt = [c[0] for c in keys], salts[0]
            new = np.zeros(len(n), bool)
            for c, last in zip(keys[:1], before[:1]):
                new |= np.concatenate([[c[0] != last], c[1:] != c[:-1]])
            parts = []
            for k in range(longest):
                c, last = keys[k + 1], before[k + 1]
                new = new | np.concatenate([[c[0] != last], c[1:] != c[:-1]])
                at = np.flatnonzero(new)
                if not len(at):
                    held[k] += int(n.sum())
                    continue
                sums = np.add.reduceat(n, at)
                done = np.concatenate([[held[k] + n[:at[0]].sum()], sums[:-1]])
                which = [np.concatenate([[last_], col[at[:-1]]]) for last_, col in zip(before, keys)]
                parts.append(closed(k, which, done, np.concatenate([[salt], salts[at[:-1]]])))
                held[k] = int(sums[-1])
            before, salt = [c[-1] for c in keys], salts[-1]
            if parts:
                yield batch_of(parts)
        if before is not None:
            last = [np.array([x]) for x in before]
            yield batch_of([closed(k, last, np.array([held[k]]), np.array([salt])) for k in range(longest)])

    return flows


class Graph:
    """The counted graph of a table of texts: `grams` (lang, w1, ..., n) by id, and `names` (id, word)."""

    def __init__(self, space: Workspace, docs: DataFrame, longest: int = LONGEST, least: int = LEAST):
        if longest < 2:
            raise ValueError("an edge has two words at least")
        self.space, self.longest, self.least = space, longest, least
        self.columns = [f"w{k + 1}" for k in range(longest)]
        texts = docs.select(F.col("lang").cast("string").alias("lang"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        seed = 0
        while True:
            survey = space.keep(texts.mapInArrow(
                _surveyed(seed), "id long, word string, lang long, w1 long, w2 long, n long"), f"survey-{seed}")
            self.names = space.keep(survey.filter("id is not null").select("id", "word").distinct(), f"names-{seed}")
            if self.names.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                break
            seed += 1  # two words with one id
        found = texts.mapInArrow(_edges(seed, longest, _hot_pairs(survey)), "lang long, salt long, n long, " + ", ".join(
            f"{c} long" for c in self.columns))
        order = ["w1", "lang", *self.columns[1:]]
        flows = found.repartition("lang", "w1", "w2", "salt").sortWithinPartitions(*order).mapInArrow(
            _flows(longest, least), "lang long, n long, " + ", ".join(f"{c} long" for c in self.columns))
        flows = space.keep(flows, "flows")
        self.grams = space.keep(
            flows.groupBy("lang", *self.columns).agg(F.sum("n").alias("n")).withColumn("size", self._size()).filter(
                (F.col("size") == 1) | (F.col("n") >= least)), "grams")

    def _size(self):
        return sum((F.col(c) != 0).cast("int") for c in self.columns)

    def phrases(self) -> DataFrame:
        """Phrases of two words and more that are frequent enough."""
        return self.grams.filter((F.col("size") > 1) & (F.col("n") >= self.least))

    def totals(self) -> DataFrame:
        """Words of each language."""
        return self.grams.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))

    def paths(self) -> DataFrame:
        """lang, begin (the first node's words), steps: the words and weights of the edges along a path.

        Frequent edges that meet in a node with one edge in and one out are joined to one path, found
        by doubling: every edge knows one further back after each round, until it knows the path's
        first edge and its distance. A ring of such nodes has no first edge; its edges stay single.
        A row has up to PATH_ROW edges.
        """
        edges = self.space.keep(self.phrases().filter(F.col("size") == self.longest).withColumn(
            "edge", F.monotonically_increasing_id()), "edges")
        into, out = self.columns[1:], self.columns[:-1]
        node = lambda cols: F.struct("lang", *[F.col(c).alias(f"n{k}") for k, c in enumerate(cols)])
        ends = edges.select(node(into).alias("node"), F.col("edge").alias("entering"), F.lit(None).cast("long").alias("leaving"))
        ends = ends.unionAll(edges.select(node(out), F.lit(None).cast("long"), "edge"))
        links = ends.groupBy("node").agg(
            F.count("entering").alias("ins"), F.count("leaving").alias("outs"),
            F.max("entering").alias("back"), F.max("leaving").alias("next")).filter(
            "ins = 1 and outs = 1 and back <> next").select("back", "next")
        state = self.space.keep(edges.select("edge").join(links, F.col("edge") == F.col("next"), "left").select(
            "edge", F.coalesce("back", "edge").alias("head"), F.col("back").isNotNull().cast("long").alias("steps")), "path-0")
        turn, left = 0, None
        while True:
            still = state.filter("steps > 0").select(F.col("head").alias("edge")).join(
                state.filter("steps > 0"), "edge", "left_semi").count()
            if still == 0 or still == left:
                break
            left, turn = still, turn + 1
            further = state.select(F.col("edge").alias("via"), F.col("head").alias("first"), F.col("steps").alias("more"))
            state = self.space.keep(state.join(further, F.col("head") == F.col("via")).select(
                "edge", F.col("first").alias("head"), (F.col("steps") + F.col("more")).alias("steps")), f"path-{turn}")
        if still:
            ring = state.filter("steps > 0").select("edge", F.col("head").alias("at")).join(
                state.filter("steps > 0").select(F.col("edge").alias("at")), "at", "left_semi").select(F.col("edge").alias("own"))
            state = state.join(ring, F.col("edge") == F.col("own"), "left").select(
                "edge", F.when(F.col("own").isNull(), F.col("head")).otherwise(F.col("edge")).alias("head"),
                F.when(F.col("own").isNull(), F.col("steps")).otherwise(0).alias("steps"))
        step = F.struct("steps", F.struct(*out).alias("node"), F.col(self.columns[-1]).alias("word"), F.col("n").alias("weight"))
        rows = edges.join(state, "edge").groupBy("lang", "head", F.floor(F.col("steps") / PATH_ROW).alias("row")).agg(
            F.sort_array(F.collect_list(step)).alias("steps"))
        return rows.select("lang", "head", "row", F.col("steps")[0]["node"].alias("begin"), "steps")

    def covers(self) -> DataFrame:
        """Of each phrase that a longer one holds: the largest count of those one word longer (lang, words, cover).

        Longer ones still are no more frequent. For nodes it is read off the compacted paths: between two
        edges of a path stands a node that no other edge meets.
        """
        paths = self.space.keep(self.paths(), "paths")
        weight = lambda at: F.try_element_at(F.col("steps"), at)["weight"]
        first, at = F.col("steps")[0]["node"], F.col("at")
        entered = F.try_element_at("steps", F.greatest(at, F.lit(1)))  # the edge into a node behind the first
        last = [*[entered["node"][c] for c in self.columns[1:-1]], entered["word"]]
        nodes = paths.select("lang", "steps", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("at")).select(
            "lang", *[F.when(at == 0, first[c]).otherwise(x).alias(c) for c, x in zip(self.columns, last)],
            F.lit(0).cast("long").alias(self.columns[-1]),
            F.greatest(F.when(at > 0, entered["weight"]), weight(at + 1)).alias("cover"))
        zero = F.lit(0).cast("long")
        for size in range(self.longest - 1, 2, -1):
            own = self.phrases().filter(F.col("size") == size)
            for begin in (0, 1):
                part = self.columns[begin:begin + size - 1]
                nodes = nodes.unionAll(own.select("lang", *[
                    (F.col(part[k]) if k < len(part) else zero).alias(c) for k, c in enumerate(self.columns)],
                    F.col("n").alias("cover")))
        return nodes.groupBy("lang", *self.columns).agg(F.max("cover").alias("cover"))


def _hot_pairs(survey: DataFrame) -> np.ndarray:
    """Digests of the pairs that begin more than one in HOT edges; there are fewer than HOT.

    A block tells of the pairs that begin one in 2 * HOT of its edges. What it keeps back of a pair is
    less than that share, so no pair of two in HOT is missed.
    """
    total = survey.filter("id is null and lang is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = survey.filter("id is null and lang is not null").groupBy("lang", "w1", "w2").agg(
        F.sum("n").alias("n")).filter(F.col("n") * HOT > F.lit(total)).collect()
    return _mixed([np.array([r[c] for r in rows], np.int64) for c in ("lang", "w1", "w2")])


def _scored(graph: Graph) -> DataFrame:
    """Phrases with the lowest-scoring of their cuts: l and r are the counts of its two parts."""
    columns, longest = graph.columns, graph.longest
    zero = F.lit(0).cast("long")
    phrases = graph.phrases().withColumnRenamed("n", "a")

    def part(first: int, last: int):
        """Words first to last, then zeros."""
        return [(F.col(columns[first + k]) if first + k < last else zero).alias(f"p{k + 1}") for k in range(longest)]

    halves = []
    for size in range(2, longest + 1):
        for cut in range(1, size):
            for side, words_ in (("l", part(0, cut)), ("r", part(cut, size))):
                halves.append(phrases.filter(F.col("size") == size).select(
                    "lang", *columns, "a", F.lit(cut).alias("cut"), F.lit(side).alias("side"), *words_))
    every = halves[0]
    for half in halves[1:]:
        every = every.unionAll(half)
    counts = graph.grams.filter(F.col("size") < longest).select(
        F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}") for c in columns], F.col("n").alias("count"))
    same = F.col("lang") == F.col("_lang")
    for k, c in enumerate(columns):
        same = same & (F.col(f"p{k + 1}") == F.col(f"_{c}"))
    cuts = every.join(counts, same).groupBy("lang", *columns, "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("count"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("count"))).alias("r"))
    # a is no larger than l and r, so a score is UNIT at most
    score = F.expr(f"(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * {UNIT}) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    return cuts.withColumn("score", score).groupBy("lang", *columns, "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")).select(
        "lang", *columns, "a", "best.l", "best.r", "best.score")


def _ranked(df: DataFrame, group: str, order: list, most: int, rank) -> DataFrame:
    """The first `most` rows of each group, found in parts that are merged round by round; adds `rank`.

    With F.rank, rows that tie with the last one stay, too.
    """
    parts = max(1, -(-df.count() // RANKED))
    df = df.withColumn("_key", F.xxhash64(*df.columns))
    while True:
        rows = Window.partitionBy(group, F.pmod("_key", F.lit(parts))).orderBy(*order)
        df = df.withColumn("rank", rank().over(rows)).filter(F.col("rank") <= most)
        if parts == 1:
            return df.drop("_key")
        parts = -(-parts // MERGED)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP,
                 space: Workspace | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to `longest` words that hold together most, by language.

    docs: text, lang; other columns are ignored. Letters A-Z are folded; `[.,;:!?\\x0A-\\x0D]` ends a piece,
    blanks and tabs part its words. A phrase of a = `least` occurrences and more is cut in two, with l and
    r occurrences of the parts in its language; its score is floor(1e6 a a / (l r)) at the cut where that
    is lowest, the first of such. Phrases of which a longer one holds `covered` per cent or more go.
    The `top` best by score, a and phrase (bytes) stay; n counts the language's words.

    * Only the longest word sequences are shuffled: the edges of a de Bruijn graph, counted before in
      each task, by the pair they begin with (and, for the few pairs that begin one in 2,000, the word
      after it). Sorted, all shorter counts are sums of neighbours, ends of pieces included.
    * Words are numbers of 64 bits in there. That no two words share one is checked over all of them;
      if two did, all would be numbered anew.

    Nulls: a null text is empty, a null lang is `und`. Empty texts have no words; very long texts and
    words are read whole. Repeated rows count again. An empty table gives no rows.
    """
    space = space or Workspace(docs.sparkSession, "collocations")
    graph = Graph(space, docs, longest, least)
    keys = ["lang", *graph.columns]
    covers = graph.covers().withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.col("lang") == F.col("_lang")
    for c in graph.columns:
        same = same & (F.col(c) == F.col(f"_{c}"))
    alone = _scored(graph).join(covers, same, "left").filter(
        F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * covered))
    best = space.keep(alone.select(*keys, "a", "l", "r", "score"), "scored")
    best = space.keep(_ranked(best, "lang", [F.desc("score"), F.desc("a")], top, F.rank).drop("rank"), "best")
    worded = best.select(*keys, F.posexplode(F.array(*graph.columns)).alias("at", "id")).filter("id <> 0").join(
        graph.names, "id").groupBy(*keys).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = space.keep(best.join(worded, keys), "named")
    last = _ranked(named, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.row_number)
    langs = graph.names.select(F.col("id").alias("lang"), F.col("word").alias("name"))
    return last.join(graph.totals(), "lang").join(langs, "lang").select(
        F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").alias("n"), "score")
