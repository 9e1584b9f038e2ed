"""Language ID of whole texts by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters and all bytes beyond ASCII but punctuation), in lower case.  Its features are hashed byte
n-grams of 1 to 4 over the whole word with marked ends - those with an end are its affixes - and its log shares in a lexicon
by language.  Transitions between the languages of neighbouring words are learned as well, from chains that join
spans of different languages, so that code-switched text is labelled word by word.  Forward-backward over the whole text gives each
word's probabilities; a text's language is the one with most of their sum, its share the score.

The model is fitted on the driver to about ``SAMPLE`` labelled texts a language, drawn by hash of the id (never over twice
as many in all), each of them whole; prediction covers every word of every text.  Counts and weights by language are as many as there
are different values of ``lang``.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row all are; ties
go to the first language by name; repeated rows are judged one by one; other columns are carried along, but for lang_pred and score, which
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textkernel import Splitter, mix, string_buffer

SAMPLE, SPAN = 120, 24
CHAIN = 64
ROWS = 1 << 16
EPOCHS, BATCH, RATE = 3, 256, 0.2
CACHE_WORDS = 400_000
#: A text of which less than this is of the likeliest language is rejected by ``keep_known``.
LEAST_SCORE = 0.4
SLICE, WORDS_AT_ONCE = 1 << 18, 1 << 17
LETTERLESS = [b for b in range(128) if not chr(b).isalpha()]


def splitter() -> Splitter:
    return Splitter(LETTERLESS, fold=True, seed=6)


def plain(data: np.ndarray) -> np.ndarray:
    """A copy in which punctuation beyond ASCII (Latin-1's, and General Punctuation) is white space."""
    out = data.copy()
    two = np.flatnonzero((data[:-1] == 0xC2) & ~np.isin(data[1:], (0xAA, 0xB5, 0xBA)))
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            out[at + k] = 0x20
    return out


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of all words' n-grams, the word of each): grams of 1 to 4 bytes of the whole word between end marks 1 and 2."""
    size = e - s
    begin = np.cumsum(size + 2) - (size + 2)
    flat = np.zeros(int((size + 2).sum()), np.uint64)
    before = np.cumsum(size) - size
    flat[np.repeat(begin + 1 - before, size) + np.arange(int(size.sum()))] = data[np.repeat(s - before, size) + np.arange(int(size.sum()))]
    flat[begin], flat[begin + size + 1] = 1, 2
    word = np.repeat(np.arange(len(s), dtype=np.int32), size + 2)
    rows, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            n = len(flat) - k
            if n <= 0:
                break
            h = h[:n] * np.uint64(0x100000001B3) + flat[k:] + np.uint64(7)
            whole = np.flatnonzero(word[k:] == word[:n])
            rows.append((mix(h[whole] + np.uint64(k << 60)) % np.uint64(ROWS)).astype(np.int32))
            owners.append(word[whole])
    return np.concatenate(rows) if rows else np.empty(0, np.int32), np.concatenate(owners) if owners else np.empty(0, np.int32)


def sums(weights: np.ndarray, rows: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """Each word's sum of weights, by language."""
    got = weights[rows]
    return np.stack([np.bincount(owner, got[:, k], words) for k in range(weights.shape[1])], 1)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # n-gram row by language
    lexicon: np.ndarray  # sorted word hashes
    shares: np.ndarray  # their log shares by language
    mixing: np.ndarray  # lexicon share by language
    moves: np.ndarray  # from language to language

    def emissions(self, hashes: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of distinct words, a slice of bytes at a time."""
        out, at = np.empty((len(s), len(self.langs))), 0
        bytes_to = np.cumsum(e - s)
        while at < len(s):
            end = max(at + 1, int(np.searchsorted(bytes_to, (bytes_to[at - 1] if at else 0) + SLICE, "right")))
            out[at:end] = sums(self.weights, *features(data, s[at:end], e[at:end]), end - at) if e[at] - s[at] <= 4 * SLICE else self._long(data[s[at] : e[at]])
            at = end
        return out + self.known(hashes) @ self.mixing

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The sum over a word of any length: its grams by slices that overlap by three bytes, end marks included."""
        marked, total = np.concatenate([[1], word, [2]]).astype(np.uint64), np.zeros(len(self.langs))
        with np.errstate(over="ignore"):
            for lo in range(0, len(marked), SLICE):
                h = np.zeros(1, np.uint64)
                for k in range(4):
                    part = marked[lo + k : lo + k + SLICE]
                    h = (h[: len(part)] if k else np.zeros(len(part), np.uint64)) * np.uint64(0x100000001B3) + part + np.uint64(7)
                    total += self.weights[(mix(h + np.uint64(k << 60)) % np.uint64(ROWS)).astype(np.int32)].sum(0, dtype=float)
        return total[None, :]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.lexicon, hashes), max(0, len(self.lexicon) - 1))
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.langs)), np.float32)
        return np.where((self.lexicon[at] == hashes)[:, None], self.shares[at], 0).astype(np.float32)


def marginals(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains (chain, place, language) -> word marginals, summed pair marginals."""
    c, t, n = emit.shape
    p = np.exp(emit - emit.max(2, keepdims=True))
    m = np.exp(moves - moves.max())
    fore = np.empty_like(p)
    fore[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        x = (fore[:, k - 1] @ m) * p[:, k]
        fore[:, k] = x / x.sum(1, keepdims=True)
    back = np.ones_like(p)
    pairs = np.zeros((n, n))
    for k in range(t - 2, -1, -1):
        y = p[:, k + 1] * back[:, k + 1]
        x = y @ m.T
        live = mask[:, k + 1, None]
        back[:, k] = np.where(live, x / np.maximum(x.sum(1, keepdims=True), 1e-30), 1)
        both = fore[:, k, :, None] * m * y[:, None, :]
        both /= np.maximum(both.sum((1, 2), keepdims=True), 1e-30)
        pairs += (both * live[:, :, None]).sum(0)
    out = fore * back
    return out / out.sum(2, keepdims=True), pairs


def whole_marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over whole texts, whatever their length: word marginals.

    Texts are laid out in stretches of ``CHAIN`` words.  What a stretch does to a forward vector is a matrix; passing vectors through these
    gives each stretch its true ends, so stretches are worked off side by side and no chain is broken."""
    n, count = emit.shape[1], np.diff(first)
    parts = -(-count // CHAIN)
    part0 = np.cumsum(parts) - parts
    total = int(parts.sum())
    place = np.repeat(part0, count) * CHAIN + (np.arange(len(emit)) - np.repeat(first[:-1], count))
    p, live = np.ones((total * CHAIN, n)), np.zeros(total * CHAIN, bool)
    p[place], live[place] = np.exp(emit - emit.max(1, keepdims=True)), True
    p, live = p.reshape(total, CHAIN, n), live.reshape(total, CHAIN)
    head = np.zeros(total, bool)
    head[part0[count > 0]] = True
    m = np.exp(moves - moves.max())
    step = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for t in range(CHAIN):
        on = np.flatnonzero(live[:, t])
        x = step[on] @ m
        if t == 0:
            x[head[on]] = step[on][head[on]]
        x *= p[on, t, None, :]
        step[on] = x / x.max((1, 2), keepdims=True)
    enter, leave = np.ones((total, n)) / n, np.ones((total, n))
    order = np.argsort(-parts, kind="stable")
    deepest = int(parts.max()) if len(parts) else 0
    for j in range(1, deepest):
        at = part0[order[: np.searchsorted(-parts[order], -j, "left")]] + j
        x = np.einsum("ci,cij->cj", enter[at - 1], step[at - 1])
        enter[at] = x / x.sum(1, keepdims=True)
    for j in range(deepest - 2, -1, -1):
        at = part0[order[: np.searchsorted(-parts[order], -(j + 1), "left")]] + j
        x = np.einsum("cij,cj->ci", step[at + 1], leave[at + 1])
        leave[at] = x / x.sum(1, keepdims=True)
    fore, back = np.empty_like(p), np.empty_like(p)
    x = np.where(head[:, None], enter, enter @ m) * p[:, 0]
    fore[:, 0] = x / x.sum(1, keepdims=True)
    for t in range(1, CHAIN):
        x = (fore[:, t - 1] @ m) * p[:, t]
        fore[:, t] = x / x.sum(1, keepdims=True)
    back[:, -1] = leave
    for t in range(CHAIN - 2, -1, -1):
        x = (p[:, t + 1] * back[:, t + 1]) @ m.T
        back[:, t] = np.where(live[:, t + 1, None], x / x.sum(1, keepdims=True), back[:, t + 1])
    out = (fore * back).reshape(-1, n)[place]
    return out / out.sum(1, keepdims=True)


def _spans(texts: list[str], langs: list[str], names: list[str], rng) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, tuple]:
    """Spans (language, word numbers) that cover the whole texts, and the distinct words: hashes, and (bytes, begin, end)."""
    data, offsets = string_buffer(pa.array(texts, pa.string()))
    data = plain(data)
    h, s, e, first = splitter().words(data, offsets)
    unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    spans = []
    for d, lang in enumerate(langs):
        lo, hi = int(first[d]), int(first[d + 1])
        while lo < hi:
            size = int(rng.integers(3, SPAN + 1))
            spans.append((names.index(lang), inverse[lo : min(hi, lo + size)]))
            lo += size
    return spans, unique, (data, s[at], e[at])


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    n = len(names)
    spans, hashes, (data, begin, end) = _spans(texts, langs, names, rng)
    counts = np.zeros((len(hashes), n), np.float32)
    for y, words in spans:
        np.add.at(counts[:, y], words, 1)
    often = np.flatnonzero(counts.sum(1) >= 3)
    share = np.log((counts[often] + 0.5) / (counts.sum(0) + 1)) if len(often) else np.zeros((0, n))
    share = (share - share.mean(1, keepdims=True)).astype(np.float32)
    model = Model(names, np.zeros((ROWS, n), np.float32), hashes[often], share, np.eye(n, dtype=np.float32) * 0.1, np.eye(n) * 1.0)
    (rows, owner), known = features(data, begin, end), model.known(hashes)
    order = np.argsort(owner, kind="stable")
    rows, grams = rows[order], np.bincount(owner, minlength=len(hashes))
    start = np.cumsum(grams) - grams
    totals = [np.full(x.shape, 1e-6) for x in (model.weights, model.mixing, model.moves)]
    for _ in range(EPOCHS if n > 1 else 0):
        # chains: spans behind each other, mostly of one language for a while
        order = rng.permutation(len(spans))
        order = order[np.argsort(np.array([spans[i][0] for i in order]) + rng.normal(0, 1.2, len(order)), kind="stable")]
        words = np.concatenate([spans[i][1] for i in order])
        gold = np.concatenate([np.full(len(spans[i][1]), spans[i][0]) for i in order])
        full = len(words) // CHAIN
        if not full:
            words, gold, full = np.resize(words, CHAIN), np.resize(gold, CHAIN), 1
        chains, labels = words[: full * CHAIN].reshape(full, CHAIN), gold[: full * CHAIN].reshape(full, CHAIN)
        for lo in range(0, full, BATCH):
            w, y = chains[lo : lo + BATCH], labels[lo : lo + BATCH]
            u, inv = np.unique(w, return_inverse=True)
            inv = inv.reshape(w.shape)
            own = np.repeat(np.arange(len(u)), grams[u])
            ids = rows[np.repeat(start[u] - (np.cumsum(grams[u]) - grams[u]), grams[u]) + np.arange(len(own))]
            emit = (sums(model.weights, ids, own, len(u)) + known[u] @ model.mixing)[inv]
            got, pairs = marginals(emit, np.ones(w.shape, bool), model.moves)
            off = got - np.eye(n)[y]
            gold_pairs = np.zeros((n, n))
            np.add.at(gold_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            by_word = np.stack([np.bincount(inv.ravel(), off[..., k].ravel(), len(u)) for k in range(n)], 1)
            grad = np.stack([np.bincount(ids, by_word[own, k], ROWS) for k in range(n)], 1)
            steps = (grad, known[u].T @ by_word, pairs - gold_pairs)
            for x, g, total in zip((model.weights, model.mixing, model.moves), steps, totals, strict=True):
                total += g * g
                x -= (RATE * g / np.sqrt(total)).astype(x.dtype)
    return model


class Labeller:
    def __init__(self, model: Model):
        self.model, self.split = model, splitter()
        self.slot: dict[int, int] = {}
        self.known = np.zeros((0, len(model.langs)), np.float32)

    def emissions(self, data, h, s, e) -> np.ndarray:
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_WORDS:
            self.slot, self.known = {}, self.known[:0]
        names = unique.tolist()
        new = np.array([k for k, x in enumerate(names) if x not in self.slot], np.int64)
        if len(new):
            base = len(self.known)
            self.known = np.concatenate([self.known, self.model.emissions(unique[new], data, s[at[new]], e[at[new]])])
            self.slot.update((names[k], base + j) for j, k in enumerate(new.tolist()))
        return self.known[np.array([self.slot[x] for x in names], np.int64)][inverse]

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's share of each language: means of its words' marginals (no words: zeros)."""
        h, s, e, first = self.split.words(data, offsets)
        n, count = len(self.model.langs), np.diff(first)
        if not len(h):
            return np.zeros((len(count), n))
        emit = self.emissions(data, h, s, e)
        # a stretch of texts at a time; one text is never divided
        got, lo = np.empty((len(h), n)), 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + WORDS_AT_ONCE, "right")) - 1)
            if first[hi] > first[lo]:
                got[first[lo] : first[hi]] = whole_marginals(emit[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], self.model.moves)
            lo = hi
        own = np.repeat(np.arange(len(count)), count)
        return np.stack([np.bincount(own, got[:, k], len(count)) for k in range(n)], 1) / np.maximum(count, 1)[:, None]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``lang`` by ``text``; ``docs`` are the rows to learn from."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    bounds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 32, (sample << 32) // n + 1))))
    # rows of one id share a hash: the limit holds the bound, whatever repeats
    near = rows.where(F.col("h") < F.element_at(bounds, F.col("lang"))).withColumn("text", F.lower("text"))
    got = near.orderBy("h", "lang", "text").limit(2 * sample * len(counts)).toArrow()
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist())


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (replaced if there)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for b in batches:
            column = b.column(b.num_columns - 1)
            data, offsets = string_buffer(column)
            pred, score = [], []
            for lo in range(0, b.num_rows, 256):
                hi = min(b.num_rows, lo + 256)
                at = offsets[lo : hi + 1]
                got = labeller.shares(plain(data[at[0] : at[-1]]), at - at[0]) if labeller else np.zeros((hi - lo, 1))
                for d in range(hi - lo):
                    best = int(got[d].argmax())
                    known = got[d, best] > 0 and _lettered(data[at[d] : at[d + 1]])
                    pred.append(shared.value.langs[best] if known else "und")
                    score.append(min(1.0, float(got[d, best])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*own, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", lang_pred string, score double"
    return docs.select(*own, F.lower("text").alias("__text")).mapInArrow(run, schema)


_ASCII = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _lettered(text: np.ndarray) -> bool:
    return bool(_ASCII[text].any()) or any(c.isalpha() for c in text.tobytes().decode(errors="replace"))


def held_out(folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)), F.lit(0)) == 0


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = train(docs.where(~held_out()))
    return label(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents stay whose language can be told with a score of ``least`` or more; ``lang``, if there, becomes that language.

    All other columns stay as they are."""
    own, tag = docs.columns, uuid.uuid4().hex[:8]
    clash = {c: f"__{c}_{tag}" for c in own if c in ("lang_pred", "score")}
    model = train(docs.where(~held_out()))
    renamed = docs.select(*(F.col(f"`{c}`").alias(clash.get(c, c)) for c in own))
    kept = label(renamed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{clash.get(c, c)}`").alias(c) for c in own))
