"""Quality rules, URL filters and their edge cases."""

import re
from collections import Counter

from listenlake.llm import quality, urls

TEXTS = [
    "", None, "   \n \t", "one two three four", "a b c a b c", "word " * 60,
    "the quick brown fox jumps over the lazy dog and runs to the river because it is late. " * 1 + " ".join(f"word{i} of" for i in range(40)),
    "# $ % & | < > *\n# $ % & | < > *\nother", "é ü 中文 the of\né ü 中文 the of", "\u00a0 x\u2003y",
]


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    places = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def test_counts_equal_a_loop(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 8)], "doc_id long, text string, n_words int")
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for row in got:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == by_hand(row.text), row
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert [r.kept for r in got if r.doc_id == 6] == [True]


def test_rules_on_no_rows(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_rule_is_a_row_of_the_table(spark):
    docs = spark.createDataFrame([(1, TEXTS[6])], "doc_id long, text string")
    strict = quality.quality_rules(docs, (quality.Rule("word_length", most=1.0),))
    assert [r.kept for r in strict.collect()] == [False]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://Example.COM/en/1?x": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/1#a": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/de/1": ("x.net", "/de/1", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)] * 2, "page_id long, url string, verdict string")
    got = {(r.url, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages).collect()}
    assert got == {(u, *want) for u, want in cases.items()}


def test_templates_of_blocked_labels_are_rejected(spark):
    rows = [(i, f"http://casino.example.org/{x}/{i}.html") for i, x in enumerate(["a", "b"] * 10)]
    rows += [(100 + i, f"http://news.example.org/{x}/{i}") for i, x in enumerate(["a", "b"] * 10)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.verdict for r in got if "casino" in r.host} == {"block"}
    assert {r.verdict for r in got if "news" in r.host} == {"allow"}
    # Branches that go on alike with alike labels are one template; numbers are one placeholder.
    assert {r.template for r in got if "casino" in r.host} == {"/~a/{n}.html"}


def test_many_rare_branches_are_one_variable(spark):
    rows = [(i, f"http://x.org/user/name{chr(97 + i % 26)}{'abcdefgh'[i // 26]}/photo") for i in range(120)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {"/user/*/photo"}


def test_urls_on_no_rows(spark):
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_labelled_bad_branch_of_a_good_host_and_deep_branches(spark):
    from listenlake.llm import urls

    rows = []
    for i in range(40):
        rows.append((len(rows), f"https://good.org/blog/post{i}x", 0))
        rows.append((len(rows), f"https://good.org/shop/item{i}x", 1))
        # Below the sixth segment the branches differ: each keeps its own template and labels.
        rows.append((len(rows), "https://deep.org/a/b/c/d/e/f/good/page", 0))
        rows.append((len(rows), "https://deep.org/a/b/c/d/e/f/spamx/page", 1))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["url"]: r for r in urls.url_filter(pages, labels="bad").collect()}
    assert got["https://good.org/shop/item3x"]["verdict"] == "block" and got["https://good.org/blog/post3x"]["verdict"] == "allow"
    deep_good, deep_bad = got["https://deep.org/a/b/c/d/e/f/good/page"], got["https://deep.org/a/b/c/d/e/f/spamx/page"]
    assert deep_good["template"] != deep_bad["template"]
    assert deep_bad["verdict"] == "block" and deep_good["verdict"] == "allow"
    # Without labels, nothing on these hosts is unwanted.
    unlabelled = urls.url_filter(pages.drop("bad")).collect()
    assert {r["verdict"] for r in unlabelled} == {"allow"}, [(r["url"], r["purity"]) for r in unlabelled if r["verdict"] != "allow"][:3]
