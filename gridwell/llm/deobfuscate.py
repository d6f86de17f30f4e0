"""Toxicity of deobfuscated text: a noisy channel restores leetspeak, spacing and repetition, a lexicon scores the result.

A character lattice is decoded with Viterbi under a trigram model of characters that is counted over all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridwell.llm.sample import labelled_sample
from gridwell.plans.runtime import quoted, tidy

#: Rows of each label that the lexicon is fitted on at most; they are the ones with the lowest hash of their text.
FIT_POSITIVE, FIT_NEGATIVE = 2000, 4000
THRESHOLD = 0.3

# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}

_SIZE = 28  # a to z, 26 a word's edge, 27 any other letter
_CODE = np.full(256, 26, np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_CODE[128:] = 27


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 27 if c and c.isalpha() else 26


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the characters of all texts; _SIZE ** 3 sums reach the driver."""

    @tidy
    def run(batches):
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                raw = "\n".join(t or "" for t in batch.column(0).slice(lo, 500).to_pylist()).encode("utf-8", "replace")
                c = _CODE[np.frombuffer(b"\n" + raw + b"\n", np.uint8)].astype(np.int32)
                total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(_SIZE**3)
    for cell, n in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out


class CharModel:
    """log P(c | two characters before), smoothed by the bigram and an even share."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_SIZE, _SIZE, _SIZE)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + _SIZE)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).tolist()

    def best(self, noisy: str, edges: bool = False) -> tuple[float, str]:
        """The likeliest letters behind noisy text and their score: signs may stand for letters or be noise, repeated
        letters may be one, a star may be any letter. With edges, what separates letters may be a word's edge.

        Exact Viterbi with back-pointers: a state is the last two letters put out, so time and memory grow with the
        length of the text.
        """
        states, back = {(26, 26): 0.0}, []
        prev, times = "", 0
        for c in noisy.lower():
            times = times + 1 if c == prev else 1
            options = [(x, cost, _code(x)) for x, cost in self.options(c, times, edges)]
            new, came = {}, {}
            for key, score in states.items():
                a, b = key
                for letter, cost, k in options:
                    if letter and (letter != " " or b != 26):
                        to, value = (b, k), score + cost + self.log[a][b][k]
                    else:
                        to, value, letter = key, score + cost, ""
                    if to not in new or new[to] < value:
                        new[to], came[to] = value, (key, letter)
            back.append(came)
            states, prev = new, c
        score, key = max((s + (self.log[a][b][26] if b != 26 else 0.0), (a, b)) for (a, b), s in states.items())
        out = []
        for came in reversed(back):
            key, letter = came[key]
            out.append(letter)
        return score, "".join(reversed(out))

    @staticmethod
    def options(c: str, times: int, edges: bool) -> list[tuple[str, float]]:
        """(letter or nothing, cost) of what a character may stand for that is the `times`-th of its run."""
        if c.isalpha():
            return [(c, 0.0)] + [("", -2.5 if times == 2 else -1.0)] * (times > 1)
        if c == "*" and not edges:
            return [*((x, -1.0) for x in _LETTERS), ("", -4.0)]
        gone = -9.0 if c in LEET else -2.0 if c == _FAR else -0.5
        return [*((x, -0.7) for x in LEET.get(c, "")), ("", gone)] + [(" ", 0.0 if c == _FAR else -0.5)] * (edges and c not in LEET)

    def decode(self, noisy: str, edges: bool = False) -> str:
        return self.best(noisy, edges)[1]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Stands for a wider separator than the others of its run.
_FAR = "\x01"
_TWICE = re.compile(r"([^\W\d_])\1")
_FIGURE = re.compile(r"[\d.,:;/\-+%$€()|!*=<>~^_#&'\"?]*")
_PIECE = r"(?:[^\W_]|[@$!|+(€]){1,2}"
_BETWEEN = r"[\s.\-_*~,/:;'\"=^]{1,4}"
_SPACED = re.compile(rf"(?<![^\W_])(?<![@$!|+(€]){_PIECE}(?:{_BETWEEN}{_PIECE}(?![^\W_]|[@$!|+(€])){{2,}}")
_SEPARATOR = re.compile(_BETWEEN)
_BREAK = re.compile(r"(?:[^\w@$!|+(€*]|_)+")
_OUTER = ".,;:?\"'()[]{}#&%*<>-_/="
#: Letters of a token that are decoded at once, and by how many the pieces of a longer one overlap.
_LONGEST, _OVERLAP = 48, 16


def _restored(token: str, model: CharModel) -> tuple[str, ...]:
    """Words that a token without white space may stand for, other than itself; figures and prices stand for none."""
    core = token.lower().strip(_OUTER).rstrip("!").rstrip(_OUTER)
    if len(core) < 2 or _FIGURE.fullmatch(core) or core.isalpha() and not _TWICE.search(core):
        return ()
    if len(core) > _LONGEST:
        parts = [x for x in _BREAK.split(core) if x]
        if parts == [core]:
            parts = [core[k : k + _LONGEST] for k in range(0, len(core) - _OVERLAP, _LONGEST - _OVERLAP)]
        return tuple(w for x in parts for w in _restored(x, model))
    out, stars = set(), core.count("*")
    if stars == 1:  # a star hides one letter, and the likeliest ones are close
        out.update(t for _, t in sorted((model.best(core.replace("*", x)) for x in _LETTERS), reverse=True)[:5])
    elif stars <= 3:
        out.add(model.decode(core))
    if stars:
        core = core.replace("*", "-")
        out.add(model.decode(core))
    if _BREAK.search(core):
        out.update(model.decode(core, edges=True).split())
    return tuple(sorted(out - {core, ""}))


def _joined(run: str, model: CharModel) -> tuple[str, ...]:
    """Words behind a run of short pieces: as one word, and with the likeliest words' edges between them."""
    run = run.lower().strip(_OUTER + " \t\r\n").lstrip("(").rstrip("! \t\r\n")
    pieces, gaps = _SEPARATOR.split(run), _SEPARATOR.findall(run)
    if len(set("".join(pieces))) < 3 or _FIGURE.fullmatch("".join(pieces)):
        return ()
    out, least = set(), min(map(len, gaps), default=0)
    for k in range(0, max(len(pieces) - _OVERLAP // 2, 1), _LONGEST - _OVERLAP):  # a long run is read in overlapping parts
        own, between = pieces[k : k + _LONGEST], gaps[k : k + _LONGEST - 1]
        out.add(model.decode("".join(own)))
        out.update(model.decode("".join(x for pair in zip(own, [*(_FAR if len(g) > least else "-" for g in between), ""]) for x in pair), edges=True).split())
    return tuple(sorted(out - set(pieces) - {""}))


def restore(text: str, model: CharModel, memo: dict | None = None) -> list[str]:
    """Restored words of the obfuscated places of a text: of every token with a sign or a repeated letter in it, and of
    every run of pieces of one or two characters."""
    memo, out = {} if memo is None else memo, set()
    for places, read in ((set(text.split()), _restored), ({m.group() for m in _SPACED.finditer(text)}, _joined)):
        for place in places:
            key = place if read is _restored else (place,)
            found = memo.get(key)
            if found is None:
                if len(memo) > 200_000:
                    memo.clear()
                found = memo[key] = read(place, model)
            out.update(found)
    return sorted(out)


_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that the lexicon considers.
STEMS = range(4, 8)


def _features(text: str, model: CharModel, memo: dict) -> set[str]:
    """Words (=word), word beginnings (^stem), what is restored included, and beginnings of two words or more of the
    text itself (+stem): a word and what it may stand for are not two words."""
    plain = set(_WORD.findall(text.lower()))
    words = plain | set(restore(text, model, memo))
    out = {"=" + w for w in words if len(w) >= 3}
    for size in STEMS:
        stems = Counter(w[:size] for w in plain if len(w) > size)
        out |= {"^" + w[:size] for w in words if len(w) > size} | {"+" + s for s, n in stems.items() if n > 1}
    return out


def fit_lexicon(rows: list[tuple[str, int]], model: CharModel, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[dict[str, float], float]:
    """feature -> P(toxic | feature), and P(toxic) without any of them. Greedy cover of the toxic rows.

    weights: labelled rows that a toxic and a clean row of the sample stand for, so that probabilities mean the same
    however many labelled rows there are.
    Rows with equal texts count once. Each step takes the feature with the most toxic rows not yet covered, less
    twenty times the share of clean rows that have it; a feature needs 1 % of the toxic rows and 5 at least. Features
    of 5 % of the toxic rows that hardly any clean row has are then added, even where others cover their rows.
    """
    memo, neg = {}, Counter()
    toxic, clean = sorted({t for t, y in rows if y}), sorted({t for t, y in rows if not y})
    number = xxhash.xxh3_64_intdigest
    floor = max(5, len(toxic) // 100)
    # features are counted by their hashes: the names of all of them would not fit a small driver
    seen, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.array([number(f) for f in _features(t, model, memo)], np.uint64) for t in toxic)]), return_counts=True)
    frequent = set(seen[times >= floor].tolist())
    own = lambda t: {f for f in _features(t, model, memo) if number(f) in frequent}
    pos = [own(t) for t in toxic]
    held = Counter(f for p in pos for f in p)
    live = {f for f, n in held.items() if n >= floor}
    for text in clean:
        neg.update(own(text) & live)
    n_neg = len(clean)
    pos = [p & live for p in pos]
    chance = lambda f: (weights[0] * held[f] + 0.5) / (weights[0] * held[f] + weights[1] * neg[f] + 1.0)
    out, left, scale = {}, list(range(len(pos))), (len(pos) + 1) / (n_neg + 1)
    while left:
        now = Counter(f for k in left for f in pos[k])
        best = max(now, key=lambda f: (now[f] - 20 * scale * neg[f], f[0] == "=", f), default=None)
        if best is None or now[best] - 20 * scale * neg[best] < floor:
            break
        p = chance(best)
        out[best] = p
        left = [k for k in left if best not in pos[k]]
    for f in sorted(live):
        if held[f] >= max(floor, len(pos) * 0.05) and neg[f] <= n_neg * 0.0005 and not any(f[1:].startswith(g[1:]) for g in out if g[0] != "="):
            out[f] = chance(f)
    base = min(0.25, (weights[0] * len(left) + 0.5) / (weights[0] * len(left) + weights[1] * n_neg + 1))
    return out, base


class Scorer:
    def __init__(self, lexicon: dict[str, float], base: float, model: CharModel):
        self.lexicon, self.base, self.model, self.memo = lexicon, base, model, {}
        self.plain = {f: (f[1:], re.compile(r"(?<![^\W\d_])" + re.escape(f[1:]) + (r"(?![^\W\d_])" if f[0] == "=" else r"[^\W\d_]+"))) for f in lexicon}

    def score(self, text: str) -> float:
        low = plain = text.lower()
        if found := restore(text, self.model, self.memo):
            low += "\n" + "\n".join(found)
        miss = 1 - self.base
        for f, (stem, pattern) in self.plain.items():
            if stem in low and (len(set(pattern.findall(plain))) > 1 if f[0] == "+" else pattern.search(low)):
                miss *= 1 - self.lexicon[f]
        return round(1 - miss, 9)


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_positive: int = FIT_POSITIVE, fit_negative: int = FIT_NEGATIVE) -> tuple[dict[str, float], float, np.ndarray]:
    """(lexicon, base, trigram counts). docs(doc_id, text): all documents for the character model; labels(doc_id, label).

    learn is a condition on doc_id that says which labels may be used; the others are read by nothing.
    """
    counts, allowed = char_counts(docs), labels.filter(learn)
    n = {r.label: r.n for r in allowed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limits = {1: fit_positive, 0: fit_negative}
    rows = labelled_sample(docs, allowed, learn, limits)
    weights = tuple(max(1.0, n.get(y, 0) / limits[y]) for y in (1, 0))
    return *fit_lexicon(rows, CharModel(counts), weights), counts


def score(docs: DataFrame, trained: tuple, keep: list[str]) -> DataFrame:
    """`keep` columns and score (0 to 1) of every row. Null and empty texts get the score of texts without evidence.

    Repeated rows and null ids stay, equal texts score alike; an empty table gives an empty one. Whole texts count; a
    very long token is decoded in overlapping parts of _LONGEST characters, so time grows with its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce("text", F.lit("")))

    @tidy
    def run(batches):
        lexicon, base, counts = shared.value
        scorer = Scorer(lexicon, base, CharModel(counts))
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                got = [scorer.score(t) for t in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(got, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())]))
