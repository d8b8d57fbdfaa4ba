"""Words behind disguises."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from listenlake.llm import bytewords, similarity, toxicity, workers

PLAIN = "you are a complete idiot and a stupid moron or a pathetic fool who has no idea what other people say about the weather in town "


@pytest.fixture(scope="module")
def reader():
    counts = np.zeros(toxicity.SYMBOLS ** toxicity.ORDER, dtype=np.int64)
    for batch in toxicity.count_grams(iter([pa.record_batch({"text": [PLAIN * 50]})])):
        counts[batch.column("gram").to_numpy()] += batch.column("n").to_numpy()
    return toxicity.Restorer(counts)


def words_of(reader, text):
    data, start, end, _, found = reader.words(pa.array([text]))
    return {data[a:b].tobytes().decode() for a, b in zip(start, end)} | {w for _, w in found}


@pytest.mark.parametrize("text, want", [
    ("idiot,moron", {"idiot", "moron"}), ("stupid/pathetic", {"stupid", "pathetic"}), ("you-idiot", {"you", "idiot"}),
    ("a i d i o t", {"idiot"}), ("you i d i o t s t u p i d", {"idiot", "stupid"}), ("“idiot”", {"idiot"}), ("moron…", {"moron"}),
    ("idiot—moron", {"idiot", "moron"}), ("1d10t,m0r0n", {"idiot", "moron"}), ("i.d.i.o.t", {"idiot"}), ("st​upid", {"stupid"}),
])
def test_words_joined_to_neighbours_are_found(reader, text, want):
    assert want <= words_of(reader, text)


@pytest.mark.parametrize("text, want", [
    ("you " + "i" * 30 + "d" + "i" * 30 + "o" * 20 + "t", {"you", "idiot"}), ("y o u a r e " * 3 + "a c o m p l e t e i d i o t " * 3, {"complete", "idiot"}),
    (",".join(["weather"] * 20 + ["m0r0n"]), {"weather", "moron"}), ("x" * 5 + "-1d10t" * 20_000, {"idiot"}),
])
def test_long_disguises_are_decoded(reader, text, want):
    assert want <= words_of(reader, text)


@pytest.mark.parametrize("work", [
    toxicity.count_grams, lambda batches: (similarity.shingle_sets(x) for batch in batches for x in texts_of_rounds(batch))], ids=["count_grams", "shingle_sets"])
def test_a_batch_is_worked_on_in_small_rounds(work):
    # Two workers an executor hold such arrays beside the JVM; they must not grow with the batch.
    peaks = []
    for rows in (500, 2_000):
        batch = pa.record_batch({"text": [f"{i} {PLAIN * 20}" for i in range(rows)]})
        tracemalloc.start()
        for _ in work(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < 40 and peaks[1] < 1.2 * peaks[0]


def texts_of_rounds(batch):
    return (batch.column("text").slice(a, b - a) for a, b in bytewords.rounds(batch.column("text")))


def test_scores_do_not_depend_on_how_texts_are_put_together(monkeypatch, reader):
    texts = ["you 1d10t", "", None, PLAIN * 30, "a i d i o t", "x" * 5_000, "m0r0n,weather " * 50, PLAIN]
    shared = type("Shared", (), {"value": (-1.0, np.ones(toxicity.SYMBOLS ** toxicity.ORDER, dtype=np.float32))})
    found = []
    for limit in (1, 4_000, 1 << 20):
        monkeypatch.setattr(bytewords.rounds, "__defaults__", (limit,))
        batch = pa.record_batch({"text": pa.array(texts, pa.string())})
        rows = toxicity.score_batches(shared, 0.1, {"idiot": 0.9, "moron": 0.8, "weather": 0.5}, ["text"], iter([batch]))
        found.append([s for x in rows for s in x.column("score").to_pylist()])
    assert found[0] == found[1] == found[2] and max(found[0]) > 0.9


def test_buffers_of_executors_are_kept_small_unless_the_session_says_otherwise(spark):
    size, ranges = "spark.sql.execution.arrow.maxBytesPerBatch", workers.RANGES_AT_ONCE
    given = spark.conf.get(size), spark.conf.get(ranges, None)
    try:
        spark.conf.set(size, str(64 << 20))
        spark.conf.unset(ranges)
        workers.send_package(spark)
        assert int(spark.conf.get(size)) <= 8 << 20 and spark.conf.get(ranges) == "false"
        spark.conf.set(ranges, "true")
        workers.send_package(spark)
        assert spark.conf.get(ranges) == "true"
    finally:
        spark.conf.set(size, given[0])
        spark.conf.set(ranges, given[1]) if given[1] is not None else spark.conf.unset(ranges)
