"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text.  A text is parsed by each
automaton into longest matches: a phrase ends where the automaton has no way on.  ``phrases * log2(sample
length) / symbols`` estimates the cross entropy, and the least one wins.

Texts are lower-cased; each letter is its own symbol, and a run of anything else is one blank.  A letter that a
language's sample lacks is a phrase of its own there.  Long texts are parsed in stretches that advance together; the
phrase that a stretch leaves open is carried into the next one until both parses start a phrase at one symbol, from
where they agree, so the result is the longest-match parse of the whole text.

Bounds of the sample: ``DOCS_A_LANGUAGE`` whole documents a language in the order of a hash, of which it takes
documents until they hold ``SAMPLE_CHARS`` characters; documents of more than ``TEXT_BYTES`` are not learned from.

Defined results: ``und`` with score 0 for a null text or one without letters, and for any if nothing can
be learned; ties go to the first language in order; ids may repeat or be null; other columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bytetext import U64
from .folds import fold
from .shared import table

FOLDS, HELD_OUT = 4, 2
DOCS_A_LANGUAGE = 60
SAMPLE_CHARS = 40_000
TEXT_BYTES = 4 << 20
STRETCH = 1024
LANES = 2048
BLANK, UNSEEN = 0, 1
DENSE_CELLS = 1 << 25
SPREAD = U64(0x9E3779B97F4A7C15)


def letters_table() -> np.ndarray:
    """Which code points are letters."""
    known = np.zeros(0x110000, bool)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            known[code] = True
    return known


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state by symbol; state 0 is the start."""
    ways: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for symbol in symbols:
        new = len(ways)
        ways.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in ways[at]:
            ways[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = ways[at][symbol]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                copy = len(ways)
                ways.append(dict(ways[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and ways[at].get(symbol) == to:
                    ways[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return ways


class Automata:
    """The automata of all languages in one table of transitions.  A state is the place of its row; a transition's key is
    the state plus the symbol.  A small alphabet has a cell for every key; for any other, keys lie in a hash table."""

    def __init__(self, samples: dict[str, str], cells: int = DENSE_CELLS):
        self.languages = sorted(samples)
        lowered = [np.frombuffer(samples[k].lower().encode("utf-32-le", "replace"), np.uint32) for k in self.languages]
        letter = letters_table()
        seen = np.unique(np.concatenate([x[letter[x]] for x in lowered])) if lowered else np.zeros(0, np.uint32)
        self.code = np.where(letter, UNSEEN, BLANK).astype(np.int32)
        self.code[seen] = np.arange(2, 2 + len(seen))
        width = 2 + len(seen)
        self.bits, roots, keys, values, states = [], [], [], [], 0
        for language in self.languages:
            symbols = self.encode(samples[language])[0]
            ways = suffix_automaton(symbols.tolist())
            roots.append(states * width)
            self.bits.append(np.log2(max(2, len(symbols))))
            sizes = [len(way) for way in ways]
            owner = np.repeat(np.arange(len(ways)) + states, sizes)
            keys.append(owner * width + np.fromiter((s for way in ways for s in way), np.int64, sum(sizes)))
            values.append((np.fromiter((to for way in ways for to in way.values()), np.int64, sum(sizes)) + states) * width)
            states += len(ways)
        self.roots = np.array(roots, np.int64)
        keys, values = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, values))
        self.dense = None
        if states * width <= min(cells, 2**31 - 1):
            self.dense = np.full(states * width, -1, np.int32)
            self.dense[keys] = values
        else:
            self.fill(keys, values)

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols, one blank for a run of non-letters, and whether there is a letter."""
        symbols = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        letter = symbols != BLANK
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(keep):
            keep[0] = True
        return symbols[keep], bool(letter.any())

    def fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: a key lies in the first free slot from its own on."""
        size = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - size), (1 << size) - 1
        self.keys, self.values = np.full(1 << size, -1, np.int64), np.full(1 << size, -1, np.int64)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several that want one slot the last stays
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * SPREAD) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, negative where there is no way on."""
        keys = states + symbols
        if self.dense is not None:
            return self.dense[keys].astype(np.int64)
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            there = self.keys[at[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[at[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out

    def advance(self, states: np.ndarray, roots: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, whether a phrase starts with the symbol); an unknown symbol is a phrase of its own."""
        to = self.step(states, symbols)
        none = to < 0
        start = none | (states == roots)
        stuck = np.flatnonzero(none)
        if len(stuck):
            own = roots[stuck]
            again = self.step(own, symbols[stuck])
            to[stuck] = np.where(again < 0, own, again)
        return to, start

    def apart(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase starts, end states), by language and stretch, of stretches parsed each from its own start."""
        n, languages = len(sizes), len(self.roots)
        starts = np.zeros((languages, n, grid.shape[1]), bool)
        order = np.argsort(-sizes, kind="stable")
        alive = np.searchsorted(-sizes[order], -np.arange(grid.shape[1]), "left")
        rows = np.ascontiguousarray(grid[order].T)
        state = np.repeat(self.roots[:, None], n, axis=1)
        roots = state.copy()
        found = np.zeros((grid.shape[1], languages, n), bool)
        for j in range(grid.shape[1]):
            live = alive[j]
            if live == 0:
                break
            symbol = np.broadcast_to(rows[j, :live], (languages, live)).ravel()
            now, start = self.advance(state[:, :live].ravel(), roots[:, :live].ravel(), symbol)
            state[:, :live] = now.reshape(languages, live)
            found[j, :, :live] = start.reshape(languages, live)
        starts[:, order] = found.transpose(1, 2, 0)
        ends = np.empty_like(state)
        ends[:, order] = state
        return starts, ends

    def carried(self, grid, sizes, starts, ends, chosen: np.ndarray, lanes: np.ndarray, states: np.ndarray):
        """Go on from ``states`` into stretches ``lanes`` of languages ``chosen``, each until it starts a phrase where the
        stretch's own parse does: (phrases of the stretch, its end state)."""
        count = np.zeros(len(lanes), np.int64)
        ended = states.copy()
        agreed = np.full(len(lanes), grid.shape[1])
        live = np.arange(len(lanes))
        for j in range(grid.shape[1]):
            live = live[sizes[lanes[live]] > j]
            if len(live) == 0:
                break
            now, start = self.advance(ended[live], self.roots[chosen[live]], grid[lanes[live], j])
            met = start & starts[chosen[live], lanes[live], j]
            done = live[met]
            agreed[done] = j
            ended[done] = ends[chosen[done], lanes[done]]
            count[live[~met]] += start[~met]
            ended[live[~met]] = now[~met]
            live = live[~met]
        later = np.arange(grid.shape[1])[None, :] >= agreed[:, None]
        return count + (starts[chosen, lanes] & later).sum(axis=1), ended

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """(languages, texts): how many phrases each longest-match parse has."""
        total = np.zeros((len(self.languages), len(coded)), np.int64)
        length = np.array([len(c) for c in coded], np.int64)
        owner = np.repeat(np.arange(len(coded)), -(-length // STRETCH))
        low = (np.arange(len(owner)) - np.searchsorted(owner, owner)) * STRETCH
        open_states = self.roots
        for at in range(0, len(owner), LANES):
            who, begin = owner[at : at + LANES], low[at : at + LANES]
            sizes = np.minimum(STRETCH, length[who] - begin)
            grid = np.zeros((len(who), int(sizes.max())), np.int32)
            for i, (text, a, n) in enumerate(zip(who, begin, sizes)):
                grid[i, :n] = coded[text][a : a + n]
            starts, ends = self.apart(grid, sizes)
            counts = starts.sum(axis=2)
            held = ends.copy()
            assumed = np.full_like(ends, -1)
            while True:
                before = np.concatenate([open_states[:, None], held[:, :-1]], axis=1)
                chosen, lanes = np.nonzero((begin > 0)[None, :] & (before != assumed))
                if len(lanes) == 0:
                    break
                assumed[chosen, lanes] = before[chosen, lanes]
                counts[chosen, lanes], held[chosen, lanes] = self.carried(grid, sizes, starts, ends, chosen, lanes, before[chosen, lanes])
            open_states = held[:, -1]
            np.add.at(total.T, who, counts.T)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [self.encode(t) for t in texts]
        length = np.array([len(c) for c, _ in coded], np.int64)
        entropy = self.phrases([c for c, _ in coded]) * np.array(self.bits)[:, None] / np.maximum(1, length)
        labels, scores = [], []
        for i, (_, lettered) in enumerate(coded):
            if not lettered or not self.languages:
                labels.append("und")
                scores.append(0.0)
                continue
            ranked = np.sort(entropy[:, i])
            labels.append(self.languages[int(np.argmin(entropy[:, i]))])
            scores.append(1.0 if len(ranked) == 1 else float(ranked[1] / max(1e-12, ranked[0] + ranked[1])))
        return labels, scores


def learn_samples(docs: DataFrame, per_language: int = DOCS_A_LANGUAGE, chars: int = SAMPLE_CHARS, text_bytes: int = TEXT_BYTES) -> dict[str, str]:
    """Whole texts of each language from the learning documents, within the bounds of the module's head."""
    known = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    text = F.col("text").cast("string")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    ranked = known.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text")).where(F.octet_length("text") <= text_bytes)
    ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    held = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = ranked.withColumn("held", F.coalesce(held, F.lit(0))).where(F.col("held") < chars).collect()
    samples: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        samples[row["lang"]] = samples.get(row["lang"], "") + " " + row["text"]
    return {k: v for k, v in samples.items() if any(c.isalpha() for c in v)}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, lang_pred, score), one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(Automata(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                labels, scores = sent.value.predict([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_samples(docs)).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
