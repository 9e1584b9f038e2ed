"""The training-data operators on small fixtures: brute force, round trips, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tideline.llm import chat_format, components, decontaminate, language_id, license_scan, lm_score, ngram_join, packing, sharding, substring_dedup, topk_search
from tideline.llm.common import Scratch
from tideline.llm.textkernel import SPACES, Splitter, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], DOCS)


def prose(seed, n=40, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    out = [(0, base), (1, " ".join(near)), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Two words"), (8, "É à ü"), (9, prose(2, 6000)), (9, prose(2, 6000)), (None, base), (None, None), (10, base + " " + prose(3, 30))]
    return out + [(20 + i, prose(50 + i)) for i in range(5)] + [(40 + i, "x" * 300_000 + " y z") for i in range(2)]


def test_splitter_matches_regex_across_slices():
    r = random.Random(5)
    texts = ["".join(r.choice("ab C\n\t é") for _ in range(r.randrange(0, 60))) for _ in range(200)] + ["q" * 400_000 + " tail", "", "a b " * 70_000]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, s, e, first = Splitter(SPACES, fold=True).words(data, offsets)
    for d, x in enumerate(raw):
        got = [data[s[i] : e[i]].tobytes() for i in range(first[d], first[d + 1])]
        assert got == SPLIT.findall(x)
    by = {}
    for i in range(len(h)):
        by.setdefault(data[s[i] : e[i]].tobytes().lower(), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    w, pos = windows(h, first, 3)
    assert len(pos) == sum(max(0, int(n) - 2) for n in np.diff(first))


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6) * (1 + i % 5)], 1) for i in range(300)] + [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [0.0] * 5, 1), (400, [0.0] * 6, 1), (500, [1.0, 2.0], 1), (501, [2.0, 1.0], 1), (None, [1.0] * 6, 1)]
    rows += [(7, rows[7][1], 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk_search.top_k(v, v.where("vec_id % 100 = 0"), k=10).collect()
    fine = [(i, np.floor(1024 * np.array(e)).astype(int)) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    for q, e in fine:
        if q % 100 == 0:
            want = sorted((-(int(e @ p)), i) for i, p in fine if i != q and len(p) == len(e))[:10]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [(-s, i) for _, i, s in mine] == want and [k for k, _, _ in mine] == list(range(1, len(want) + 1))
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_prunes_without_loss(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", 7)
    r = np.random.default_rng(4)
    p = r.normal(size=(200, 4))
    s = topk_search._Searcher(np.arange(5) + 1000, np.floor(1024 * p[:5]).astype(int), 3)
    import pyarrow as pa

    q = np.floor(1024 * p).astype(int)
    for lo in range(0, 200, 50):
        s.see(pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 50)), pa.array(q[lo : lo + 50].tolist())], ["id", "v"]))
    got = s.found().to_pydict()
    for k in range(5):
        want = sorted((-(int(q[k] @ q[i])), i) for i in range(200))[:3]
        assert sorted((-a, i) for o, i, a in zip(got["query_id"], got["id"], got["score"], strict=True) if o == 1000 + k) == want


CHATS = "conv_id long, turn int, role string, text string, spans string"


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 1, "assistant", None), (2, 0, None, "#<:\\\\"), (None, 0, "assistant", "a"), (3, 0, "assistant", ""), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, "system", " </turn>\n### x: ")]
    got = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], CHATS)).collect()}
    assert [(r, t) for r, t in chat_format.parse(got[1]["formatted"])] == [("user", hard), ("assistant", hard)]
    assert chat_format.parse(got[2]["formatted"]) == [("", "#<:\\\\"), ("assistant", "")]
    loss = lambda r: [chat_format.unescape(r["formatted"][s["loss_start"] : s["loss_stop"]]) for s in r["spans"]]
    assert loss(got[1]) == ["", hard] and loss(got[3]) == ["", "same", "same"] and loss(got[None]) == ["a"]
    assert all("".join(r["formatted"][s["start"] : s["stop"]] for s in r["spans"]) == r["formatted"] for r in got.values())
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).count() == 0


@pytest.mark.parametrize("text", [" x", " ", "  ", " </turn>\n", "x ", " x ", ": y"])
def test_loss_mask_of_texts_that_begin_like_the_tail(text):
    turns = [("user", " a"), ("assistant", text), ("assistant", text)]
    for template in (chat_format.plain_template, lambda t: "".join(f"[{r}]: {x} : [/{r}]" for r, x in t)):
        formatted, spans, _ = chat_format.locate(turns, template)
        got = [formatted[s[3] : s[4]] for s in spans[1:]]
        assert (list(map(chat_format.unescape, got)) if template is chat_format.plain_template else got) == [text, text]


@pytest.mark.parametrize("template", [chat_format.plain_template, lambda t: "<s>" + chat_format.plain_template(t), lambda t: "".join(f"{k}:{x};" for k, (_, x) in enumerate(t))])
def test_blocks_find_the_same_spans(template):
    turns = [(("user", "assistant")[k % 2], f"text {k} #" * (k % 3)) for k in range(41)]
    assert chat_format.locate(turns, template, 6) == chat_format.locate(turns, template, 1000)


def test_rewriting_template_is_told():
    last_first = lambda turns: "|".join(t for _, t in reversed(turns))
    assert chat_format.locate([("user", "a"), ("assistant", "b")], last_first)[2]
    same = [("assistant", "aa"), ("assistant", "aaa")]
    text, spans, _ = chat_format.locate(same, lambda t: "".join(f"a{x}a" for _, x in t))
    assert [text[s[3] : s[4]] for s in spans] == ["aa", "aaa"]


def test_rewriting_inside_a_block_is_told():
    turns = [("user", f"t{k}") for k in range(300)]
    once = lambda t: ("!" if len(t) == 200 else "") + chat_format.plain_template(t)
    assert chat_format.locate(turns, once) == (once(turns), [], True)


def test_decontaminate(spark):
    item = prose(9, 20)
    bench = spark.createDataFrame([(1, item), (10, item), (2, "tiny item"), (3, None), (4, ""), (5, "x")], "item_id long, text string")
    inside = "A, " + item.upper().replace(" ", " - ") + " b"
    d = docs(spark, [(1, inside), (2, "a tiny  ITEM here"), (3, None), (4, ""), (5, prose(8, 50)), (5, prose(8, 50)), (None, "x"), (6, item + " " + prose(7, 900))])
    got = {r["doc_id"]: r for r in decontaminate.report(d, bench).collect()}
    assert got[1]["n_hit"] == 20 and got[1]["n_items"] == 2 and got[1]["contaminated"]
    assert got[1]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest()
    assert got[2]["n_hit"] == 2 and got[None]["n_hit"] == 1 and not got[6]["contaminated"] and got[3]["n_words"] == 0
    assert decontaminate.report(d, bench).count() == 8
    assert decontaminate.report(d, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(d, bench)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 5, 6]
    assert kept.where("n_words <> 'y' or score <> 'x'").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d, bench).collect()}
    assert cut[2] == "a here" and cut[5] == prose(8, 50) and cut[1] == "A, b" and cut[6] == prose(7, 900)
    both = decontaminate.decontaminate(d, bench, cut=True)
    assert both.columns == d.columns and {r["doc_id"]: r["text"] for r in both.collect()}[6] == prose(7, 900)


def test_decontaminate_beyond_the_broadcast(spark, monkeypatch):
    item = prose(9, 20)
    bench = spark.createDataFrame([(1, item), (10, item + " more"), (2, "tiny item"), (3, None), (None, "x")], "item_id long, text string")
    rows = [(1, "A, " + item.upper().replace(" ", " - ") + " b"), (2, "a tiny  ITEM here tiny item"), (3, None), (4, ""), (5, item), (5, item), (None, "x"), (6, item + " " + prose(7, 9000))]
    d = docs(spark, rows)
    want = sorted(map(str, decontaminate.report(d, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(str, decontaminate.report(d, bench).collect())) == want and len(want) == len(rows)
    assert decontaminate.report(d, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("names", [("__row", "h", "w", "k1", "hit_words", "hit_items", "at", "items")])
def test_decontaminate_leaves_columns_of_any_name(spark, names):
    d = docs(spark, [(1, "a tiny item b " + prose(1, 90)), (2, None)]).selectExpr("*", *(f"'{n}' {n}" for n in names))
    bench = spark.createDataFrame([(1, "tiny item")], "item_id long, text string")
    for kept in (decontaminate.decontaminate(d, bench, cut=True), decontaminate.remove_spans(d, bench), ngram_join.keep_one(d)):
        assert kept.columns == d.columns and all(r[n] == n for r in kept.collect() for n in names) and kept.count() == 2


def test_benchmark_items_without_an_id(spark):
    item, other = prose(9, 20), prose(10, 20)
    bench = spark.createDataFrame([(None, item), (None, item), (7, item), (None, other)], "item_id long, text string")
    d = docs(spark, [(1, item), (2, other), (3, prose(11))])
    got = {r["doc_id"]: r for r in decontaminate.report(d, bench).collect()}
    assert [got[k]["n_hit"] for k in (1, 2, 3)] == [20, 20, 0] and [got[k]["n_items"] for k in (1, 2, 3)] == [2, 1, 0]
    assert [got[k]["items_sha256"] for k in (1, 2)] == [hashlib.sha256(x).hexdigest() for x in (b"7", b"")]
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()] == [3]


def test_license_scan(spark):
    d = docs(spark, [(1, "x\nReleased under the MIT licence.\ny"), (2, "Released under the MIT License.\nReleased under the MIT License."), (3, None), (4, ""), (5, prose(1)), (None, "licensed under cc by-nc 4.0")])
    got = {(r["doc_id"], r["license_id"]): r for r in license_scan.scan(d).collect()}
    assert got[(2, "MIT")]["dice"] == 1.0 and got[(2, "MIT")]["n_units"] >= 2 and (None, "CC-BY-NC-4.0") in got and not any(k[0] in (3, 4, 5) for k in got)


def best_window(text, template, threshold=0.8):
    pairs = lambda x: list(zip(w := re.findall("[a-z0-9]+", x.lower()), w[1:], strict=False))
    words, goal = pairs(text), set(pairs(template))
    found = [2 * len(goal & set(words[i:j])) / (len(goal) + len(set(words[i:j]))) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    return round(max(found), 6) if found and max(found) >= threshold else None


def test_license_inside_longer_texts(spark):
    mit, gpl = (next(t for a, t in license_scan.TEMPLATES if a == k and len(t) > 200) for k in ("MIT", "GPL-3.0"))
    wrapped = "/*\n * " + " ".join(f"{w}\n *" if k % 9 == 8 else w for k, w in enumerate(gpl.split())) + f"\n */\n{prose(6)}"
    short = "released under the mit license"
    rows = [(1, f"{prose(1)} Copyright (c) 2020 A. {mit} The above copyright notice shall be included. {prose(2)}"), (2, wrapped), (3, f"{prose(3)} {short} {prose(4)} {short} {prose(5, 2000)}"), (4, " ".join([short] * 400))]
    for k in range(40):
        r = random.Random(k)
        rows.append((10 + k, " ".join(x for w in short.split() * 4 for x in r.choices(([w], [], [w, "a"], [w, w]), (8, 1, 1, 1))[0])))
    got = {(r["doc_id"], r["license_id"]): r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[(1, "MIT")]["dice"] == 1.0 and got[(1, "MIT")]["n_units"] == 1 and got[(2, "GPL-3.0")]["dice"] == 1.0
    assert got[(3, "MIT")]["n_units"] == 2 and got[(4, "MIT")]["dice"] == 0.888889
    one = [("MIT", short)]
    got = {r["doc_id"]: r["dice"] for r in license_scan.scan(docs(spark, rows[4:]), one).collect()}
    whole = lambda t: 2 * len(a & b) / (len(a) + len(b)) if (a := set(zip(t.split(), t.split()[1:], strict=False))) and (b := set(zip(short.split(), short.split()[1:], strict=False))) else 0
    want = {k: round(whole(t), 6) if whole(t) >= 0.8 else best_window(t, short) for k, t in rows[4:]}
    assert got == {k: x for k, x in want.items() if x} and len(got) > 5


def brute_substring(rows):
    owner, out = {}, []
    key = lambda i: (i is None, i or 0)
    words = [(i, SPLIT.findall((t or "").encode())) for i, t in rows]
    for i, w in sorted(words, key=lambda x: key(x[0])):
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), key(i))
    for i, w in words:
        stay = [True] * len(w)
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < key(i):
                stay[k : k + 13] = [False] * 13
        kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        out.append((i, len(w), len(w) - sum(stay), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def substring_rows():
    rows = odd_texts()
    r = random.Random(1)
    pool = [prose(100 + k, 40) for k in range(6)]
    rows += [(100 + k, " ".join(r.choice(pool).split()[r.randrange(5) :] + [f"u{k}"]) + " " + prose(k, 10)) for k in range(60)]
    return rows + [(200, (prose(500, 30) + " ") * 9 + "tail"), (201, prose(500, 30) + " head"), (202, (prose(501, 30) + " ") * 5)]


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup(spark, monkeypatch, batches):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 500)
    monkeypatch.setattr(substring_dedup.duplicate_spans, "__defaults__", (batches,))
    rows = substring_rows()
    assert sorted((tuple(x) for x in substring_dedup.report(docs(spark, rows)).collect()), key=str) == brute_substring(rows)


def test_substring_dedup_keeps_other_columns(spark):
    rows = substring_rows()
    d = docs(spark, rows).selectExpr("*", "'d' doc", "'m' mark", "'s' spans", "1 start", "'r' run", "'b' bucket")
    kept = substring_dedup.remove_duplicates(d)
    assert kept.columns == d.columns and kept.count() == len(rows) and kept.where("doc = 'd' and mark = 'm' and spans = 's' and run = 'r'").count() == len(rows)
    assert {x["text"] for x in kept.where("doc_id = 2").collect()} == {""}
    assert substring_dedup.report(d.limit(0)).count() == 0 and substring_dedup.remove_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("known", [1 << 20, 0])
def test_hits_by_chance_are_settled_by_words(spark, monkeypatch, known):
    """With window hashes of 6 bits most claims are false."""
    real = substring_dedup._windows_hash
    monkeypatch.setattr(substring_dedup, "_windows_hash", lambda whole: real(whole) & np.uint64(63))
    monkeypatch.setattr(substring_dedup, "KNOWN_HASHES", known)
    rows = substring_rows()[:80] + [(5000 + i, f"one common gram of words a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}") for i in range(300)]
    scratch = Scratch(spark, "t")
    keyed = substring_dedup._marked(docs(spark, rows))
    index = substring_dedup.FingerprintIndex(spark, scratch.path(), 24)
    # the workers are other processes: hashes are cut here, and merged and settled there
    cut = [r for b in _cut_here(keyed, 24) for r in b.to_pylist()]
    merged = [substring_dedup._merge(1)(t, substring_dedup._RUN.empty_table()) for t in _by_bucket(cut)]
    hits = [(h["chunk"], h["body"]) for t in merged for row in t.to_pylist() for h in row["hits"]]
    import pyarrow as pa

    claims = pa.concat_tables([substring_dedup._claims(pa.table({"chunk": [c] * len(v), "body": pa.array(v, pa.binary())})) for c in {c for c, _ in hits} for v in [[x for k, x in hits if k == c]]])
    spans = substring_dedup.verified(keyed, spark.createDataFrame(claims), scratch).groupBy("doc", "mark").applyInArrow(substring_dedup._spans, "doc long, mark long, spans binary")
    gone = {}
    for r in spans.collect():
        gone[r["doc"]] = int(np.diff(np.frombuffer(r["spans"], "<i8").reshape(-1, 2), axis=1).sum())
    want = {i if i is not None else substring_dedup.LAST: n for i, _, n, _ in brute_substring(rows) if n}
    assert gone == want and len(claims) > 100
    index.drop()


def _cut_here(keyed, nb):
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    real, substring_dedup.TaskContext = substring_dedup.TaskContext, Task
    try:
        t = keyed.toArrow()
        return list(substring_dedup._cutter(nb, Splitter(SPACES, fold=False))(pa.Table.from_arrays([c.combine_chunks() for c in t.columns], names=t.column_names).to_batches()))
    finally:
        substring_dedup.TaskContext = real


def _by_bucket(rows):
    import pyarrow as pa

    for b in sorted({r["bucket"] for r in rows}):
        part = [r for r in rows if r["bucket"] == b]
        yield pa.table({"bucket": [b] * len(part), "chunk": [r["chunk"] for r in part], "body": pa.array([r["body"] for r in part], pa.binary())})


def test_index_is_taken_up_again(spark, monkeypatch):
    scratch = Scratch(spark, "t")
    old, new = [(i, prose(i, 60)) for i in range(30)], [(100 + i, prose(i, 40) + f" new{i}") for i in range(40)]
    index = substring_dedup.FingerprintIndex(spark, scratch.path(), 24)
    marked = lambda rows: substring_dedup._marked(docs(spark, rows))
    assert index.add(marked(old[:15])).count() == 0 and index.add(marked(old[15:])).count() == 0
    index.compact()
    again = substring_dedup.FingerprintIndex.open(spark, index.path, 24, index.version)
    assert again.runs == 1
    claims = again.add(marked(new))
    assert {r["doc"] for r in claims.collect()} == {100 + i for i in range(30)} and again.runs == 2
    plan = spark.table(again.table)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    again.drop()


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    texts = [prose(1, 400), "a b", prose(2, 30), "z" * 2000 + " end", prose(3, 500)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    s = Splitter(SPACES, fold=False)
    got, want = {}, {}
    for lo, n, h, counts, base in substring_dedup._parts(s, data, offsets):
        first = np.concatenate([[0], np.cumsum(counts)])
        w, pos = windows(h, first, 13)
        for x, p in zip(w.tolist(), pos.tolist(), strict=True):
            k = int(np.searchsorted(first, p, "right")) - 1
            got.setdefault((lo + k, p - int(first[k]) + int(base[k])), x)
    for d in range(len(raw)):
        h, _, _, first = s.words(data, offsets[d : d + 2])
        want |= {(d, int(p)): x for x, p in zip(windows(h, first, 13)[0].tolist(), windows(h, first, 13)[1], strict=True)}
    assert got == want


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = SPLIT.findall((t or "").encode().lower()) if (t or "").isascii() else SPLIT.findall((t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2048, 8])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows, r = odd_texts(), random.Random(2)
    for g in range(4):
        base = prose(300 + g, 80).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            rows.append((1000 + g * 100 + k, " ".join(w)))
    d = docs(spark, rows)
    got = sorted((tuple(x) for x in ngram_join.report(d).collect()), key=str)
    assert got == brute_join(rows)
    if block == 2048:
        kept = ngram_join.keep_one(d)
        assert kept.columns == d.columns
        assert ngram_join.report(d.limit(0)).count() == 0


def test_each_component_of_a_repeated_id_keeps_a_row(spark):
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(3, a), (9, a), (9, b), (9, b), (9, c), (10, c), (11, ""), (11, None), (11, prose(63, 80)), (None, b)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (9, b), (9, c), (11, None), (11, prose(63, 80)), (None, b)], key=str)


def test_tree_bounds_lose_nothing():
    r = np.random.default_rng(1)
    points = r.poisson(2, (500, 64))
    n = points.sum(1)
    tree = ngram_join.Tree(n, points)
    for i in range(0, 500, 25):
        at, bound = tree.search(int(n[i]), points[i])
        every = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(every >= ngram_join.needed(n, n[i]))
        assert sorted(at) == want.tolist() and (every[at] == bound).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 99), (-5, 200)]
    got = {r["key"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {got[k] for k in range(31)} == {0} and got[100] == got[101] == got[99] == 99 and got[200] == -5 and len(got) == 36
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = odd_texts() + [(70, "it's “quoted” 3.14 naïvé <|endoftext|>x  İstanbul ΣΑΣ end")]
    got = packing.pack(docs(spark, rows), with_ids=True).collect()
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    parts, bins = {}, {}
    for r in got:
        ids = r["ids"]
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        parts.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], ids))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (i, n), p in parts.items():
        mine = [ids for k, ids in want if k == i and len(ids) == n]
        if len(mine) == 1:
            assert [x for _, ids in sorted(p) for x in ids] == mine[0]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    assert packing.pack(docs(spark, []), None).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_have_the_ids_of_whole_texts(name):
    """Also with a tokenizer of another structure, which keeps case and spaces."""
    encoder = packing.WordEncoder(packing.tokenizer_path(name))
    assert encoder.by_pieces == name.startswith("word")
    r = random.Random(7)
    parts = ["it's", "'s", "!'s", "a!'sb", "'re'", "don'T", "3.14", "x1y2", "e\u0301a", "=\u0338", "a=\u0338b", "İs", "ΣΑΣ!", "«à»", "naïve-ish", "\u00a0", "--", "A", "b", " ", "\t", "\n", "...", "'", "\x01", "漢字", "🙂!", "'ll", "#9'd", "١٢", "<", "|>"]
    for k in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(20)] + (["<|endoftext|> it's"] if k % 10 == 0 else [])
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        ids, begin = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == want


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(1)
    sizes = sorted((r.randrange(1, 101) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        k = next((i for i, x in enumerate(rooms) if x >= s), None)
        if k is None:
            rooms.append(100)
            k = len(rooms) - 1
        want.append((k, 100 - rooms[k]))
        rooms[k] -= s
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_sharding(spark):
    rows = [x for x in odd_texts() if len(x[1] or "") < 20_000] + [(1000 + i, "hot copy " * 20) for i in range(400)] + [(2000 + i, prose(i, 10 + i % 90)) for i in range(800)]
    got = sharding.shard(docs(spark, rows), shards=16).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(16))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    even = sharding.shard(docs(spark, [(i, prose(i, 30 + i % 50)) for i in range(3000)]), shards=16).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in even]
    assert max(sizes) < 1.03 * min(sizes)
    assert sharding.shard(docs(spark, []), shards=4).count() == 0


def test_equal_texts_share_a_shard(spark):
    rows = [(i, prose(i, 30 + i % 50)) for i in range(2000)] + [(5000 + 100 * k + i, prose(9000 + k, 90)) for k in range(7) for i in range(8 + 2 * k)]
    got = sharding.shard(docs(spark, rows), shards=16).collect()
    where, sizes = {}, [0] * 16
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(rows) and {len(x) for x in where.values()} == {1}
    assert max(sizes) < 1.03 * min(sizes)


def test_many_shards(spark):
    rows = [(i, prose(i % 2900, 20 + i % 50)) for i in range(3000)]
    got = sharding.shard(docs(spark, rows), shards=300).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 300 and max(sizes) < 2 * sum(sizes) / 300


def test_seats():
    seats, held = sharding.seat([(1, 9), (2, 5), (3, 5), (4, 2)], 3)
    assert held == [9, 7, 5] and seats == {1: 0, 2: 1, 3: 2, 4: 1}


def test_language_id(spark):
    words = {"en": "the of and in that with which from house water".split(), "de": "der die und nicht ein straße für über haus wasser".split(), "fr": "le la et dans où été maison eau très leçon".split()}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for i in range(240) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, " ".join(words["fr"]), None), (None, "the of and in that", "en"), (904, "…", "de"), (905, "", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' source", "cast(1 as long) n_chars", "'old' score")
    got = {x["doc_id"]: x for x in language_id.predict(d).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902, 904, 905)) and got[903]["lang_pred"] == "fr"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    kept = language_id.keep_known(d)
    assert kept.columns == d.columns and kept.where("score <> 'old'").count() == 0 and kept.count() == len(rows) - 5
    assert {x["doc_id"]: x["lang"] for x in kept.collect()}[903] == "fr"
    assert language_id.predict(d.withColumn("lang", d["lang"].substr(100, 1)).where("lang is null")).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(d.limit(0)).count() == 0


def test_forward_backward_matches_enumeration():
    from itertools import product

    r = np.random.default_rng(2)
    e, m = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    got, _ = language_id.marginals(e, np.ones((1, 4), bool), m)
    want, total = np.zeros((4, 3)), 0
    for y in product(range(3), repeat=4):
        p = np.exp(sum(e[0, k, y[k]] for k in range(4)) + sum(m[y[k], y[k + 1]] for k in range(3)))
        total += p
        for k in range(4):
            want[k, y[k]] += p
    assert np.allclose(got[0], want / total)


@pytest.mark.parametrize("sizes", [(1,), (64,), (65,), (0, 3, 64, 200, 129, 0, 500)])
def test_chains_of_whole_texts_are_not_broken(sizes):
    r = np.random.default_rng(5)
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, m = r.normal(size=(int(first[-1]), 3)) * 2, r.normal(size=(3, 3)) * 2
    got = language_id.whole_marginals(e, first, m)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            want, _ = language_id.marginals(e[None, a:b], np.ones((1, b - a), bool), m)
            assert np.allclose(got[a:b], want[0])


def test_features_cover_whole_words(monkeypatch):
    words = ["a", "straße", "абвгдежзиклмнопрстуфхцчшщ" * 9]
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    rows, owner = language_id.features(data, starts, ends)
    assert np.bincount(owner).tolist() == [sum(max(0, len(x) + 2 - k) for k in range(4)) for x in raw]
    model = language_id.Model(["x", "y"], np.random.default_rng(1).normal(size=(language_id.ROWS, 2)), np.empty(0, np.uint64), np.zeros((0, 2)), np.eye(2), np.eye(2))
    whole = model.emissions(np.zeros(3, np.uint64), data, starts, ends)
    monkeypatch.setattr(language_id, "SLICE", 16)
    assert np.allclose(whole, model.emissions(np.zeros(3, np.uint64), data, starts, ends))
    assert language_id.plain(np.frombuffer("a“b” c… ¿d ª".encode(), np.uint8)).tobytes().decode().split() == ["a", "b", "c", "d", "ª"]


def test_lm_score(spark):
    r = random.Random(4)
    rows = [(i, " ".join(x for _ in range(15) for x in (f"a{r.randrange(30)}", "B", f"c{r.randrange(5)}"))) for i in range(400)] + [(900, None), (901, "unseen words"), (None, "a1 b c1"), (902, "a1 b c1 " * 20_000)]
    got = {x["doc_id"]: x for x in lm_score.score(docs(spark, rows)).collect()}
    tokens = {i: [*SPLIT.findall((t or "").lower().encode()), None] for i, t in rows}
    count = {}
    for i, w in tokens.items():
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        x = got[i]
        assert x["n_tokens"] == len(w) and x["n_known"] == sum(t in count for t in w) and x["train_tokens"] == n
        assert abs(x["base_score"] - base) < 1e-6 * max(1, abs(base)) and x["score"] <= 0
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert lm_score.score(docs(spark, [])).count() == 0


def test_lm_score_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 1 << 12)
    table = docs(spark, [(i, prose(i, 30, 60)) for i in range(600)] + [(None, prose(1)), (7, None), (7, "a b"), (7, "a b")])
    two, seven = (sorted((str(r["doc_id"]), r["score"]) for r in lm_score.score(table.repartition(n)).collect()) for n in (2, 7))
    assert [i for i, _ in two] == [i for i, _ in seven]
    assert np.allclose([x for _, x in two], [x for _, x in seven], rtol=1e-9)


def test_lm_probabilities_sum_to_one():
    h = np.arange(1, 3001, dtype=np.uint64)
    place = np.where(np.arange(3000) < 2048, np.arange(3000), -1)
    voc = lm_score.Vocabulary(10_000, 3_500, h, np.full(3000, 3), place)
    model = lm_score.Model(voc)
    model.classes += np.random.default_rng(1).normal(size=model.classes.shape).astype(np.float32)
    model.members += np.random.default_rng(2).normal(size=model.members.shape).astype(np.float32)
    rows = np.repeat(lm_score.histories(np.array([7, 9], np.uint64), np.array([0, 2]))[:, 1:], 2049, 1)
    classes, _, some, k, _, members = lm_score.scores(model, rows, np.append(np.arange(2048), -1))
    inside = lm_score.log_share(classes[some], k) + lm_score.log_share(members, np.arange(2048) % 64)
    total = np.exp(inside).sum() + np.exp(lm_score.log_share(classes[-1:], np.array([32])))[0]
    assert abs(total - 1) < 1e-3


def test_lm_history_tells_tokens_outside_the_classes_apart(spark):
    r = random.Random(9)
    often = [f"f{i}" for i in range(2100) for _ in range(40)]
    pairs = [f"left{i} right{i}" for i in range(40) for _ in range(30)]
    words = often + pairs
    r.shuffle(words)
    rows = [(None, " ".join(words[k : k + 60])) for k in range(0, len(words), 60)]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:80]
    rows += [(i, f"f1 left{k} right{k} f2") for k, i in enumerate(held[:40])] + [(i, f"f1 left{k} right{(k + 7) % 40} f2") for k, i in enumerate(held[40:])]
    got = {x["doc_id"]: x for x in lm_score.score(docs(spark, rows)).where("held_out").collect()}
    same, other = (np.array([got[i]["score"] for i in ids]) for ids in (held[:40], held[40:]))
    assert np.allclose([got[i]["base_score"] for i in held], got[held[0]]["base_score"])
    assert same.mean() > other.mean() + 0.2


def test_lm_shares_outside_the_classes_sum_to_one():
    r = np.random.default_rng(3)
    h, n = np.unique(r.integers(1, 2**63, 3000, dtype=np.uint64) * np.uint64(2)), r.integers(1, 50, 3000)
    cells = np.bincount((h >> np.uint64(54)).astype(np.int64), n + 0.1, 1 << 10).astype(np.float32)
    cells[5] = 0
    h, n = h[h >> np.uint64(54) != 5], n[h >> np.uint64(54) != 5]
    model = lm_score.Model(lm_score.Vocabulary(int(n.sum()), len(h), h[:0], n[:0], n[:0], cells))
    rows = np.repeat(lm_score.histories(np.array([7, 9], np.uint64), np.array([0, 2]))[:, 1:], len(h), 1)
    share = (n + 0.1) / (n + 0.1).sum()
    assert np.allclose(lm_score.log_known(model, cells, rows, h), 0, atol=1e-4)
    model.branches += r.normal(size=model.branches.shape).astype(np.float32)
    way = lm_score.log_known(model, cells, rows, h)
    assert way.std() > 0.5 and abs((np.exp(way) * share).sum() - 1) < 1e-3
    assert lm_score.log_known(model, cells, rows[:, :1], np.array([5 << 54], np.uint64)).tolist() == [0]


def test_lm_row_sums_and_far_scores():
    r = np.random.default_rng(4)
    rows, x = (r.zipf(1.3, (3, 900)) % 200).astype(np.uint16), r.normal(size=(900, 5)).astype(np.float32)
    want, times = np.zeros((200, 5)), np.bincount(rows.ravel(), minlength=200)
    for k in rows:
        np.add.at(want, k, x)
    at, sums, n = lm_score.row_sums(rows, x)
    assert sorted(at.tolist()) == np.flatnonzero(times).tolist() and np.array_equal(n, times[at]) and np.allclose(sums, want[at], atol=1e-3)
    far = np.array([[500, 499], [-500, -501], [1, 0]], np.float32)
    assert np.allclose(lm_score.log_share(far, np.zeros(3, int)), -np.log1p(np.exp(-1)))
