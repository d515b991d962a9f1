import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from anemos.llm._common import SpanHash, connected_components, labels_of, merged_components, text_slices, word_spans
from anemos.llm.simhash import xxh64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=20))
def test_xxh64_equals_the_library(parts):
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts])
    got = xxh64(buf, np.cumsum(n) - n, n)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_slices_hold_every_text_once(texts):
    arr = pa.array(texts, pa.string())
    seen = []
    for lo, hi, buf, offs in text_slices(arr, 16):
        seen += [buf[offs[i] : offs[i + 1]].tobytes() for i in range(hi - lo)]
    assert seen == [(t or "").encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0babé", max_size=12), min_size=1, max_size=6))
def test_words(texts):
    data = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(data), np.uint8)
    offs = np.cumsum([0, *map(len, data)])
    start, end, of = word_spans(buf, offs)
    want = [(i, w) for i, d in enumerate(data) for w in d.split()]
    assert [(int(i), buf[a:b].tobytes()) for a, b, i in zip(start, end, of)] == want


def test_equal_spans_have_equal_hashes():
    buf = np.frombuffer(b"xxabcdefyyabcdefzz", np.uint8)
    h = SpanHash(buf)
    assert h(np.array([2]), np.array([8]))[0] == h(np.array([10]), np.array([16]))[0]
    assert len(set(h.every(6).tolist())) == len(buf) - 6 + 1 - 1


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    near = np.zeros((len(nodes),) * 2, bool)
    for a, b in pairs:
        if a != b:
            i, j = nodes.index(a), nodes.index(b)
            near[i, j] = near[j, i] = True
    assert got == {n: nodes[k] for n, k in zip(nodes, labels_of(near))}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_refuse_too_few_rounds(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long"), rounds=1)


def test_components_of_links_found_in_turns(spark):
    rng = np.random.default_rng(5)
    links = [tuple(int(x) for x in rng.integers(0, 120, 2)) for _ in range(90)]
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = {tuple(r) for r in connected_components(make(links)).collect()}
    first = connected_components(make(links[:40]))
    part = {r["node"]: r["component"] for r in first.collect()}
    later = connected_components(make([(part.get(a, a), part.get(b, b)) for a, b in links[40:]]))
    assert {tuple(r) for r in merged_components(first, later).collect()} == whole
    none = make([])
    assert merged_components(connected_components(none), connected_components(none)).count() == 0
    assert {tuple(r) for r in merged_components(connected_components(none), later).collect()} == {tuple(r) for r in later.collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_few_links_at_once_take_few_jobs(spark, kind):
    rng = np.random.default_rng(11)
    order = (rng.permutation(400) + 1000).tolist()
    chain = list(zip(order, order[1:]))
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + chain + [(5000, i) for i in range(4000, 4100)]
    name = str if kind == "string" else int
    links = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}")
    sc = spark.sparkContext

    def jobs_of(group, **options):
        sc.setJobGroup(group, "")
        try:
            found = connected_components(links, **options)
            return {tuple(r) for r in found.collect()}, len(sc.statusTracker().getJobIdsForGroup(group))
        finally:
            sc._jsc.clearJobGroup()

    rounds, many = jobs_of(f"rounds of {kind}")
    found, few = jobs_of(f"at once, {kind}", at_once=True)
    assert found == rounds and 3 * few < many
    assert {tuple(r) for r in connected_components(links, few=10, at_once=True).collect()} == rounds  # many links go by rounds
    assert connected_components(links.limit(0), at_once=True).count() == 0
