"""Near duplicates, contamination and repeated passages against loops over all pairs."""

import hashlib
import random
import re

import pytest

from listenlake.llm import bytewords, contamination, graph, passages, similarity
from listenlake.llm.similarity import choose_boundary, least_overlap, subset_sizes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted((i, len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets))


def random_texts(seed, n=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(9999)}" for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 16, 40, 90]))] for _ in range(12)]
    shared = [f"s{i}" for i in range(25)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99999)}"
        if rng.random() < 0.3:
            words = words + shared
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    return texts + ["", None, " \t ", texts[0], "É a", "é a"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    texts = random_texts(seed)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = similarity.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == components(rows)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "zz")
    rows = [(1, "x y z"), (1, text), (0, near), (1, "x y z"), (5, None), (5, None), (None, "a b"), (7, ""), (8, "X y Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, similarity.without_near_duplicates(docs).collect()))
    want = [(1, "x y z"), (0, near), (5, None), (None, "a b"), (7, "")]
    assert len(got) >= len(want) and set(got) == set(map(str, spark.createDataFrame(want, docs.schema).collect()))
    assert similarity.without_near_duplicates(docs.limit(0)).count() == 0


def test_boundary_and_subsets():
    assert [subset_sizes(n) for n in (1, 4, 8)] == [[1], [3, 4], [6, 7, 8]]
    assert least_overlap(4, 3) == 3 and least_overlap(286, 286) == 246
    assert choose_boundary({}) == 0 and choose_boundary({1: 10, 2: 10, 7: 5}) >= 7


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in graph.connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and 5 in got
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_a_frequent_hash_is_known_to_every_task(spark, monkeypatch):
    rng = random.Random(5)
    same = " ".join(f"c{i}" for i in range(40))
    texts = [same + " " + " ".join(f"u{k}x{rng.randrange(10 ** 6)}" for _ in range(rng.choice([2, 5, 30]))) for k in range(50)]
    rows = list(enumerate(texts))
    got = similarity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == components(rows)


def contaminated_by_hand(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item_id, item in items:
            v = split(item)
            n = min(13, len(v))
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_a_loop(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of"] + [f"w{rng.randrange(60)}" for _ in range(6)])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for k in range(14)] + [(90, "Same words 1, 2"), (91, "same WORDS 1 2"), (92, None), (93, "a " * 30)]
    docs = []
    for k in range(40):
        w = [word() for _ in range(rng.choice([0, 5, 60]))]
        source = rng.choice(items)[1] or ""
        part = source.split()[rng.randrange(3):][:rng.choice([5, 13, 20, 99])]
        at = rng.randrange(len(w) + 1)
        docs.append((k, ", ".join(w[:at] + part + w[at:]).upper() if k % 3 else " ".join(w[:at] + part + w[at:])))
    docs += [(50, None), (51, ""), (52, "Same   words--1 2!"), (53, "a " * 50), (54, "É " * 20)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, contamination.decontaminate(frame, bench).select(*columns).collect())) == contaminated_by_hand(docs, items)


def test_contamination_of_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d"), (None, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    got = sorted((r.text, r.n_hit) for r in contamination.decontaminate(docs, bench).collect())
    assert got == [("a b c", 2)] * 3 + [("d", 0)]
    assert contamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination.decontaminate(docs.limit(0), bench).count() == 0


def passages_by_hand(rows):
    import pyarrow as pa

    seen, out = {}, {}
    cut = {}
    for i, t in sorted(rows):
        data, offsets = bytewords.flat(pa.array([t or ""]))
        start, end, _, piece = passages.pieces(data, offsets)
        cut[i] = [[data[a:b].tobytes() for a, b, p in zip(start, end, piece) if p == k] for k in range(piece[-1] + 1 if len(piece) else 0)]
        gone = set()
        for k in range(len(cut[i])):
            j = k
            while j < len(cut[i]) and (j - k < passages.RUN or sum(map(len, cut[i][k:j])) < passages.WORDS):
                j += 1
            if j - k >= passages.RUN and sum(map(len, cut[i][k:j])) >= passages.WORDS:
                key = tuple(w for p in cut[i][k:j] for w in p)
                if seen.setdefault(key, (i, k)) != (i, k):
                    gone |= set(range(k, j))
        out[i] = [w for k, p in enumerate(cut[i]) if k not in gone for w in p]
    return out


def test_repeated_passages_equal_a_loop(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 6, 12, 45]))) + rng.choice([".", "!", "?", ".\n"])
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(70))
    body = [" ".join(sentence() for _ in range(12)) for _ in range(10)]
    texts = [*body, body[0], body[1] + " " + body[2], *[b[:len(b) // 2] + " " + passage + " " + b[len(b) // 2:] for b in body[3:6]], "", None, "One. Two. Three.", "One. Two. Three."]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")
    got = {r.doc_id: r for r in passages.remove_repeated_passages(docs).collect()}
    want = passages_by_hand(rows)
    for i, t in rows:
        assert (got[i].text or "").encode().split() == want[i], i
        assert got[i].n_removed > 0 or got[i].text == t
    # A passage cut in anywhere, without sentence ends of its own, is found all but its edges.
    left = [len(set(passage.split()) & set(got[i].text.split())) for i in (12, 13, 14)]
    assert left[0] == len(set(passage.split())) and max(left[1:]) < 40


def test_passages_of_repeated_and_missing_ids(spark):
    long_ = " ".join(f"Word{i} and more to say here." for i in range(8))
    docs = spark.createDataFrame([(2, long_), (2, long_), (1, long_ + " New."), (None, long_), (2, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in passages.remove_repeated_passages(docs).collect())
    assert len(got) == 5 and sum(t.startswith("Word0") for _, t in got) == 1
    assert passages.remove_repeated_passages(docs.limit(0)).count() == 0


def test_the_first_place_of_a_frequent_span_is_found_in_any_task(spark):
    sentence = lambda k: f"s{k} " + " ".join(f"w{k}x{j}" for j in range(8)) + "."
    # The first partition holds 8 of the spans at the passage's beginning and 7 of those at its end, the second 20 of both.
    whole, short = " ".join(map(sentence, range(8))), " ".join(map(sentence, range(6)))
    rows = [(i, f"Only {i} here. " + (short if i == 7 else whole)) for i in range(8)] + [(i, f"Only {i} here. {whole}") for i in range(100, 120)]
    for order in (rows, rows[::-1], [rows[7], *rows[:7], *rows[8:]], [rows[0], *rows[8:], *rows[1:8]]):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(order[:8], 1).union(spark.sparkContext.parallelize(order[8:], 1)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in passages.remove_repeated_passages(docs).collect()}
        assert got[0] == rows[0][1]
        assert all(got[i].startswith(f"Only {i} here.") and "s4" not in got[i] for i, _ in rows[1:])


def spans_in(texts):
    """Of each text, the words under each of its spans."""
    import pyarrow as pa

    owner, place, length, hashed, (_, start, _, piece, first, bound) = passages.spans_of(pa.array(texts))
    edge = [*first, len(start)]
    begin = [edge[b] if b < len(edge) else len(start) for b in bound]
    return [{int(h): range(edge[bound[o] + p] - begin[o], edge[bound[o] + p + n] - begin[o]) for o, p, n, h in zip(owner, place, length, hashed) if o == k} for k in range(len(texts))]


def test_passages_without_sentence_ends_share_spans_at_any_offset():
    rng = random.Random(4)
    for n in range(51, 61):
        for kinds in (3, 20, 5000):
            for _ in range(25):
                passage = [f"p{rng.randrange(kinds)}" for _ in range(n)]
                around = [[f"x{rng.randrange(5000)}" for _ in range(rng.randrange(40))] for _ in range(4)]
                one, two = spans_in([" ".join(around[0] + passage + around[1]), " ".join(around[2] + passage + around[3])])
                at = len(around[0])
                found = {i for h in one.keys() & two.keys() for i in one[h] if at <= i < at + n}
                assert len(found) >= n - 3 * passages.GAP, (n, kinds)


def test_sentence_ends_before_quotes_and_in_other_scripts():
    import pyarrow as pa

    ends = ["end.", "end?!", 'end."', "end.)", "end.”", "(end!)”", "end…", "end。", "ends！」", "क।", "end.**", "سؤال؟"]
    others = ["end", "“quoted”", "(bracket)", '"', "”", "é", "don’t", "3.5", "中文"]
    for word, new in [(w, True) for w in ends] + [(w, False) for w in others]:
        data, offsets = bytewords.flat(pa.array([f"a {word} b"]))
        assert passages.pieces(data, offsets)[3].tolist() == [0, 0, int(new)], word
