"""Operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import bpe, decontaminate, jaccard_join, kernels, license_scan, line_dedup, quality_classifier, quality_rules, substring_dedup

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def folded(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


EDGES = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, prose(1, 120)), (4, prose(1, 120)), (5, "é ß 中文 😀"), (6, prose(2, 30_000))]


@pytest.mark.parametrize(
    "op",
    [
        substring_dedup.repeated_spans,
        bpe.encode,
        line_dedup.dedup_lines,
        license_scan.scan_licenses,
        jaccard_join.near_groups,
        lambda d: decontaminate.overlaps(d, d.selectExpr("doc_id AS item_id", "text", "1 AS start_token")),
        lambda d: quality_rules.score_documents(d, d.select("doc_id", "lang")),
        lambda d: quality_classifier.classify(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic", "text")),
    ],
    ids=["op1", "op3", "op5", "op9", "op10", "op7", "op6", "op8"],
)
def test_nulls_repeats_long_texts_and_clashing_columns(make, op):
    assert rows(op(make(*EDGES, extra=True))) == rows(op(make(*EDGES)))
    assert op(make()).count() == 0


@pytest.mark.parametrize("stage", [line_dedup.deduplicated, jaccard_join.one_of_each, lambda d: decontaminate.without_overlaps(d, d.limit(0).selectExpr("doc_id AS item_id", "text")), lambda d: quality_classifier.keep_clean(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))], ids=["5", "10", "7", "8"])
def test_stages_keep_all_columns(make, stage):
    docs = make(*EDGES, extra=True)
    out = stage(docs)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert stage(make(extra=True)).count() == 0


def test_repeated_spans_brute_force(make):
    passage = prose(7, 60)
    docs = [(i, f"{prose(10 + i, 30)} {passage if i % 3 else passage[:200]} {prose(50 + i, 20)}") for i in range(12)] + [(20, " ".join(["x"] * 80))]
    seen, want = Counter(), []
    split = {i: t.split() for i, t in docs}
    for w in split.values():
        seen.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    for i, w in split.items():
        run = []
        for k in [k for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] > 1]:
            if run and k <= run[-1] + 50:
                run.append(k)
            else:
                want += [(i, run[0], run[-1] + 50, len(run))] if run else []
                run = [k]
        want += [(i, run[0], run[-1] + 50, len(run))] if run else []
    assert rows(substring_dedup.repeated_spans(make(*docs))) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abst'sdmlvre \n\t éßöA1٣!?中😀\x00 　"), max_size=60))
def test_bpe_equals_merges_and_round_trips(encoder, text):
    machine, want = encoder.machine, []
    for piece in bpe.pieces(text):
        slow = machine.merge(piece.encode())
        assert machine.encode(piece.encode()) == slow
        want += slow
    assert encoder.encode(text) == want
    assert bpe.Decoder(machine.ranks).decode(want) == text


def test_bpe_transducer_states(encoder):
    machine = bpe.Transducer(encoder.machine.ranks)
    for word in (b"streaming", b"aaaaaaaaaa" * 300, bytes(range(256))):
        assert machine.encode(word) == machine.merge(word)
    made = machine.made
    assert made > 250 and all(machine.encode(word) == machine.merge(word) for word in (b"streaming", b"aaaaaaaaaa" * 300))
    assert machine.made == made  # all moves are known


def test_bpe_goes_through_the_transducer(encoder, monkeypatch):
    """Every byte of every new piece is a step; tokens leave after bounded lookahead."""
    fresh, steps = bpe.Encoder(encoder.machine.ranks), []
    step = bpe.Run.step
    monkeypatch.setattr(bpe.Run, "step", lambda run, data: (steps.append(len(data)), step(run, data))[1])
    text = prose(3, 500) + " naïve " + "x" * 5000
    assert fresh.encode(text) == [t for piece in bpe.pieces(text) for t in fresh.machine.merge(piece.encode())]
    assert sum(steps) == sum(len(p.encode()) for p in set(bpe.pieces(text)))
    run, held, out = bpe.Run(fresh.machine), 0, []
    for c in b"streaming-caf\xc3\xa9" * 100:
        out += run.push(bytes([c]))
        held = max(held, len(run.ends))
    assert out + run.end() == fresh.machine.merge(b"streaming-caf\xc3\xa9" * 100) and held <= 2 * max(map(len, fresh.machine.ranks))


def test_bpe_of_strings_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'6162FF20C3' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'A9' AS STRING) UNION ALL SELECT 3L, 'é'")
    assert [(r.doc_id, r.round_trip) for r in bpe.encode(docs).orderBy("doc_id").collect()] == [(1, True), (2, True), (3, True)]
    assert rows(bpe.decode(bpe.encode(docs))) == [(1, "ab\ufffd \ufffd"), (2, "\ufffd"), (3, "é")]
    odd = spark.sql("SELECT 1L AS doc_id, array(-1, 7000000, NULL) AS tokens")
    assert rows(bpe.decode(odd)) == [(1, "\ufffd" * 3)]


def test_bpe_query_decodes_incrementally(monkeypatch):
    """round_trip is what the incremental decoder says, over all tokens of every text."""
    with open(bpe.VOCABULARY, "rb") as f:
        sent = type("Sent", (), {"value": f.read()})
    fed, push = [], bpe.Decoder.push
    monkeypatch.setattr(bpe.Decoder, "push", lambda decoder, ids: (fed.append(len(ids)), push(decoder, ids))[1])
    docs = pa.record_batch({"doc_id": [1, 2, 3, 4], "text": ["naïve 😀 text", None, "", prose(5, 300)]})
    (out,) = bpe._encode_rows(sent)([docs])
    assert out.column(3).to_pylist() == [True, None, True, True]
    assert sum(fed) == sum(n or 0 for n in out.column(1).to_pylist()) > 300
    monkeypatch.setattr(bpe.Utf8, "feed", lambda held, new: ("wrong", b""))
    (out,) = bpe._encode_rows(sent)([docs])
    assert out.column(3).to_pylist() == [False, None, True, False]


def test_workers_drop_the_caches_of_operators_before():
    """A worker that encoded text doesn't keep the transducer's states while it signs sets."""
    with open(bpe.VOCABULARY, "rb") as f:
        bpe._worker(f.read())
    assert bpe._made
    docs = pa.record_batch({"doc": [1], "text": [prose(5, 300)]})
    assert list(jaccard_join._sign_rows(2, 0.7, 4, 1)([docs])) and not bpe._made


def test_bpe_keeps_no_more_than_its_limits(encoder, monkeypatch):
    """Within one batch as well; what goes is computed anew, and all tokens stay right."""
    for name, most in (("MAX_STATES", 60), ("MAX_PAIRS", 40), ("MAX_WORDS", 100)):
        monkeypatch.setattr(bpe, name, most, raising=False)
    few = bpe.Encoder(encoder.machine.ranks)
    text = " ".join(f"w{k * 7919 % 1009}q{k}" for k in range(1500)) + " " + prose(4, 500)
    for _ in range(2):
        assert few.encode(text) == [t for piece in bpe.pieces(text) for t in encoder.machine.merge(piece.encode())]
        assert len(few.known) + len(getattr(few, "older", ())) <= 100 and len(few.machine.pairs) <= 40


def test_tasks_give_memory_back(monkeypatch):
    """When a task ends or is left, and when the next operator's tasks find caches of another."""
    given = []
    bpe._made.clear()
    monkeypatch.setattr(kernels, "_held", [])
    monkeypatch.setattr(kernels, "give_back", lambda: given.append(len(bpe._made)))
    with open(bpe.VOCABULARY, "rb") as f:
        sent = type("Sent", (), {"value": f.read()})
    docs = pa.record_batch({"doc_id": [1], "text": [prose(5, 300)]})
    list(bpe._encode_rows(sent)([docs]))
    task = bpe._encode_rows(sent)([docs, docs])
    next(task)
    task.close()
    assert given == [0, 1, 1]
    people = pa.record_batch({"text": [prose(5, 300)], "people": pa.array([1], pa.int32())})
    assert list(quality_classifier._mark_rows([people])) and given == [0, 1, 1, 0, 0]


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") % 2 for i in range(n)]


def test_fingerprints_are_not_forged(make):
    """A word of Thue and Morse and its complement collide in every polynomial modulo 2**64."""
    pair = ["".join("ab"[x ^ flip] for x in thue_morse(2048)) for flip in (0, 1)]
    docs = make(*((i, f"{w} {prose(9, 49)}") for i, w in enumerate(pair)))
    assert rows(substring_dedup.repeated_spans(docs)) == []
    assert all(r.round_trip for r in bpe.encode(docs).collect())
    words = [" ".join("ab"[x ^ flip] for x in thue_morse(2048)) for flip in (0, 1)]
    assert rows(substring_dedup.repeated_spans(make(*enumerate(words)), 2048)) == []
    twelve = [" ".join([w, *(f"q{k}" for k in range(11))]) for w in pair]
    found = decontaminate.overlaps(make((1, twelve[0])), make((2, twelve[1])).selectExpr("doc_id AS item_id", "text"))
    assert rows(found) == [(1, 2, 0, 12, 1)]  # one substitution, which is tolerated
    assert rows(jaccard_join.near_groups(make(*((i, f"{w} y") for i, w in enumerate(pair))))) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streaming_utf8(data, step):
    held, out = b"", ""
    for k in range(0, len(data), step):
        text, held = bpe.Utf8.feed(held, data[k : k + step])
        out += text
    assert out + ("�" if held else "") == data.decode("utf-8", "replace")
    text, held = bpe.Utf8.bytewise(data)
    assert text + ("�" if held else "") == data.decode("utf-8", "replace")


def test_bpe_decode(make):
    docs = make((1, "naïve 😀 text"), (2, None), (3, ""))
    assert rows(bpe.decode(bpe.encode(docs))) == [(1, "naïve 😀 text"), (2, None), (3, "")]


def line_store_rows(store):
    return rows(store.table), rows(store.ledger), {r.doc_id: r.drops for r in store.dropped().collect()}


def test_line_store_is_reversible(spark, make, tmp_path):
    first = make(*[(i, "\n".join(f"line {k % 7} {k % (i + 2)}" for k in range(20))) for i in range(8)])
    more = make(*[(10 + i, "\n".join(f"line {k % 5} {k}" for k in range(20))) for i in range(5)], (None, "line 1 1"))
    store = line_dedup.LineStore(spark, f"file://{tmp_path}/a", 4).insert(first)
    before = line_store_rows(store)
    store.insert(more)
    both = line_dedup.LineStore(spark, f"file://{tmp_path}/b", 4).insert(first.unionByName(more))
    assert line_store_rows(store) == line_store_rows(both)
    store.delete(more.select("doc_id"))
    assert line_store_rows(store) == before
    keys = store.table.select("k1", "k2", "shard").toPandas()
    for r in store.filters.collect():
        f = line_dedup.CuckooFilter.load(r.cells)
        own = keys[keys.shard == r.shard]
        assert len(f) == len(own) and f.has(line_dedup._keys(pa.Table.from_pandas(own))).all()


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(1, 1 << 62, 4000).astype(np.uint64)
    f = line_dedup.CuckooFilter(4000)
    assert f.add(keys) and f.has(keys).all()
    assert f.has(keys + np.uint64(1)).mean() < 0.01
    f.remove(keys[:2000])
    assert f.has(keys[2000:]).all() and f.has(keys[:2000]).mean() < 0.01


def overlap_brute_force(docs, items):
    out = []
    for i, t in docs:
        for q, s in items:
            w, x = folded(t or ""), folded(s or "")
            hit = [a for a in range(len(w) - 11) if any(sum(p == r for p, r in zip(w[a : a + 12], x[b : b + 12])) >= 10 for b in range(len(x) - 11))]
            run = []
            for a in [*hit, 1 << 60]:
                if run and a > run[-1] + 12:
                    out.append((i, q, run[0], run[-1] + 12, len(run)))
                    run = []
                run.append(a)
    return sorted(out, key=repr)


def test_decontamination_brute_force(spark, make):
    rng = np.random.default_rng(3)
    items = [(k, prose(100 + k, 14 + 3 * k)) for k in range(6)] + [(9, "too short"), (10, None)]
    docs = []
    for k in range(30):
        words = items[k % 6][1].split()
        for at in rng.integers(0, len(words), k % 5):
            words[at] = f"other{at}"
        docs.append((k, f"{prose(200 + k, 20)} {' '.join(words).upper() if k % 2 else ', '.join(words)} {prose(300 + k, 9)}"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = overlap_brute_force(docs, items)
    assert want and rows(decontaminate.overlaps(make(*docs), benchmark)) == want
    clean = {r.doc_id for r in decontaminate.without_overlaps(make(*docs), benchmark).collect()}
    assert clean == {i for i, _ in docs} - {r[0] for r in want}


def test_decontamination_in_slices(spark, make, monkeypatch):
    items = [(k, prose(100 + k, 20)) for k in range(5)]
    docs = make(*[(k, prose(9, 5) + " " + items[k][1]) for k in range(5)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = rows(decontaminate.overlaps(docs, benchmark))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 150)
    assert rows(decontaminate.overlaps(docs, benchmark)) == whole and len(whole) == 5


def grams(text):
    w = folded(text or "")
    return set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}


def groups_brute_force(docs, least=jaccard_join.LEAST):
    sets = {i: grams(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in sets if find(i) != i}


def test_jaccard_join_brute_force(make):
    rng, docs = np.random.default_rng(5), []
    for k in range(160):
        words = prose(k // 8, 3 + (k // 8) * 12).split()
        for at in rng.integers(0, len(words), int(len(words) * (k % 8) * 0.02)):
            words[at] = f"edit{rng.integers(1000)}"
        docs.append((k, " ".join(words)))
    docs += [(500 + k, docs[k][1]) for k in range(0, 160, 9)] + [(700, "Hello, world"), (701, "hello world"), (702, "one"), (703, "One")]
    want, links = groups_brute_force(docs), links_brute_force(docs)
    got = jaccard_join.near_groups(make(*docs)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.n_links for r in got} == {i: links[i] for i, _ in want}
    kept = {r.doc_id for r in jaccard_join.one_of_each(make(*docs)).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def links_brute_force(docs, least=0.7) -> dict[int, int]:
    """Other texts, by the documents that are first to have them, that each document's text is similar to."""
    sets, first = {i: grams(t) for i, t in docs}, {}
    for i, t in docs:
        first[t] = min(i, first.get(t, i))
    near = lambda x, y: len(x & y) >= least * len(x | y) > 0
    return {i: sum(j != first[t] and near(sets[i], sets[j]) for j in set(first.values())) for i, t in docs}


def test_jaccard_join_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = groups_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, r.kept_doc_id) for r in jaccard_join.near_groups(docs).collect()} == want and want


def test_jaccard_join_of_large_buckets(make, monkeypatch):
    """Buckets and groups beyond a block are cut, and nothing is lost."""
    base = prose(4, 60).split()
    docs = [(i, " ".join([*base[: i % 50], f"own{i}", *base[i % 50 + 1 :]])) for i in range(60)]
    whole = set(map(tuple, jaccard_join.near_groups(make(*docs)).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    assert set(map(tuple, jaccard_join.near_groups(make(*docs)).collect())) == whole and len(whole) == 59


def test_partenum_signatures_meet():
    """Pairs at the threshold or above share a signature, at every size; the bound says that none is missed."""
    rng = np.random.default_rng(8)
    for size in (2, 3, 4, 5, 7, 9, 12, 20, 30, 63, 64, 90, 200, 700, 3000):
        for _ in range(30):
            common = rng.integers(1, 1 << 40, size)
            only = int(size * 0.3 / 0.7 / 2)
            a, b = (np.unique(np.r_[common, rng.integers(1, 1 << 40, only)]) for _ in range(2))
            both = [set(jaccard_join.signatures(np.zeros(len(x), np.int64), x.astype(np.uint64), 1, 0.7)[1].tolist()) for x in (a, b)]
            assert both[0] & both[1]
            c = np.r_[a, rng.integers(1 << 41, 1 << 42, int(len(a) * 0.3 / 0.7))]  # all that differs on one side
            assert both[0] & set(jaccard_join.signatures(np.zeros(len(c), np.int64), c.astype(np.uint64), 1, 0.7)[1].tolist())
    assert max(jaccard_join.missed(int(low)) for low in jaccard_join.bands(0.7, 1000)[0]) < 1e-9


def test_signatures_tell_strangers_with_common_phrases_apart():
    """Sets of 24 to 60 features with a fifth in common hardly ever meet; candidates would grow with the square of the corpus."""
    rng, met = np.random.default_rng(4), 0
    for size in (24, 40, 60):
        shared = rng.integers(1, 1 << 40, size // 5)
        sets = [np.unique(np.r_[shared, rng.integers(1, 1 << 40, size - size // 5)]) for _ in range(80)]
        row = np.repeat(np.arange(80), [len(x) for x in sets])
        own, sig = jaccard_join.signatures(row, np.concatenate(sets).astype(np.uint64), 80, 0.7)
        holders = {}
        for i, x in zip(own.tolist(), sig.tolist()):
            holders.setdefault(x, set()).add(i)
        met += len({(i, j) for h in holders.values() for i in h for j in h if i < j})
    assert met < 0.012 * 3 * 80 * 79 / 2


@pytest.mark.parametrize("size", [100, 3000])
def test_sketches_rule_out_strangers_and_no_similar_pair(size):
    """Of large sets too: else strangers are one group, whose sets go to many tasks."""
    rng = np.random.default_rng(6)
    feature = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    common, out = feature(size), []
    for k in range(8):
        out.append(np.sort(np.r_[common, feature(int(size * 0.02 * k))]))  # 0.7 at least
    out += [np.sort(np.r_[common[: size // 4], feature(size * 3 // 4)]) for _ in range(8)]
    row = np.repeat(np.arange(16), [len(x) for x in out])
    sketch = jaccard_join.sketches(row, np.concatenate(out), 16)
    x, y = np.triu_indices(16, 1)
    fine = jaccard_join.may_be_similar(sketch, np.array([len(s) for s in out]), x, y, 0.7)
    near = np.array([len(np.intersect1d(out[i], out[j])) >= 0.7 * len(np.union1d(out[i], out[j])) for i, j in zip(x, y)])
    assert near.any() and fine[near].all() and fine[~near].mean() < 0.1


def template_recall(make, features: int, shared: int, pair: int, pairs: int = 500) -> float:
    """Share of near pairs found among documents with one template: `shared` 2-grams in all of them, `pair` more in a pair."""
    template, docs = " ".join(f"t{k}" for k in range(shared + 1)), []
    for i in range(2 * pairs):
        own = [f"p{i // 2}x{k}" for k in range(pair)] + [f"o{i}x{k}" for k in range(features - shared - pair)]
        docs.append((i, f"{template} {' '.join(own)}"))
    got = {(r.kept_doc_id, r.doc_id) for r in jaccard_join.near_groups(make(*docs)).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(pairs)}
    return len(got) / pairs


def test_jaccard_join_of_larger_sets_that_share_a_template(make):
    assert template_recall(make, 80, 65, 2) == 1
