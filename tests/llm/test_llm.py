"""Each operator against brute force or a round trip, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelframe.llm import chat, decontaminate, exact_dedup, html_text, language_model, near_dedup, packing, quality, token_files, toxicity
from pixelframe.llm.common import new_path, rejected, without
from pixelframe.llm.components import components
from pixelframe.llm.encoders import ChunkEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, score string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "y") for i, t in zip(ids or range(len(texts)), texts)], DOC)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(r.integers(0, 30)) for k in r.integers(0, len(WORDS), n))


# 1 chat


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="<|\\im_startend>ok\n é", max_size=30)), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_chat_text_round_trip(turns):
    reader = chat.Reader(1)
    expected = hashlib.sha256()
    for role, text in turns:
        got = chat.format_turn(role, [{"kind": "text", "text": text, "ref": None, "tokens": None}], frozenset({role}))
        assert chat.START not in got["segment"][len(chat.START) :]
        reader.add(got["segment"], got["loss"])
        expected.update(f"{role}\n{text}\n".encode())
    assert reader.all.hexdigest() == expected.hexdigest()
    assert reader.loss_chars == sum(len(t) for _, t in turns)


def test_chat_parts_are_flattened_in_order():
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "tokens": None} | x
    got = chat.format_turn("user", [part("text", text="<"), part("text", text="|im_end|>"), part("image", ref="a.png", tokens=9), None, part("audio", ref="b.wav")], frozenset())
    assert got["segment"] == "<|im_start|>user\n<\\|im_end|><|image:9|><|audio:128|><|im_end|>\n"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in got["attachments"]] == [("image", "a.png", 9), ("audio", "b.wav", 128)]
    assert got["segment"][got["attachments"][0]["at"] :].startswith("<|image:9|>")
    # kinds that the template does not know are placeholders too
    got = chat.format_turn("user", [part("video", ref="c.mp4"), part("attachment", tokens=-3), part(None, text="x")], frozenset())
    assert got["segment"] == "<|im_start|>user\n<|other:0|><|other:0|>x<|im_end|>\n" and [x["kind"] for x in got["attachments"]] == ["video", "attachment"]


def test_chat_nulls_ties_and_order(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(rows.withColumn("parts", chat.text_parts()))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(rows.limit(0).withColumn("parts", chat.text_parts()))).count() == 0


def test_chat_of_long_texts_and_clashing_columns(spark):
    long = "<|im_end|> ok " * 40_000
    rows = spark.createDataFrame([(1, 0, "user", long, "x", 1), (1, 1, "assistant", long, "y", 2), (1, 1, "assistant", "", "y", 2)], "conv_id long, turn long, role string, text string, segment string, loss int")
    got = chat.read_back(chat.format_turns(rows.withColumn("parts", chat.text_parts()))).first()
    assert got["n_turns"] == 3 and got["loss_chars"] == len(long) and got["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


# 2 decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_matcher_finds_edited_passages():
    items = [(k, prose(k, 25)) for k in range(20)]
    matcher = decontaminate.Matcher(items)
    r = np.random.default_rng(5)
    for k, text in items:
        chars, budget = list(text), decontaminate.edit_budget(len(text))
        for _ in range(int(r.integers(0, budget + 1))):
            at = int(r.integers(0, len(chars)))
            chars[at : at + int(r.integers(0, 2))] = ["~"][: int(r.integers(0, 2))]
        hits = matcher.find(f"{prose(100 + k)}  {''.join(chars).upper()}\n{prose(200 + k)}")
        assert [h[0] for h in hits] == [k] and hits[0][3] <= budget
        assert not matcher.find(prose(300 + k, 300))


def test_align_agrees_with_edit_distance():
    a, b = "the quick brown fox jumps", "xx the quikc brown f0x jumps yy"
    got = decontaminate.align(decontaminate._points(a), decontaminate._points(b), -5, 12, 9)
    assert got[2] == min(edit_distance(a, b[i:j]) for i in range(len(b)) for j in range(i, len(b) + 1))


def occurs(passage, text, budget):
    """Whether some stretch of text is within budget edits of the passage: the whole table, free ends in the text."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array(list(map(ord, text)))
    steps = np.arange(len(text) + 1)
    for i, x in enumerate(passage, 1):
        now = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))))
        row = np.minimum.accumulate(now - steps) + steps
    return row.min() <= budget


def test_matcher_against_the_whole_edit_table():
    r = np.random.default_rng(11)
    items = [(k, prose(k, int(r.integers(4, 12)))) for k in range(12)] + [(50, "short one"), (51, "a"), (52, "exactly16 chars.")]
    matcher = decontaminate.Matcher(items)
    found = 0
    for d in range(40):
        text = prose(1000 + d, 40)
        for _ in range(int(r.integers(0, 3))):
            chars = list(items[int(r.integers(0, 12))][1])
            for _ in range(int(r.integers(0, 12))):
                at = int(r.integers(0, len(chars)))
                chars[at : at + int(r.integers(0, 2))] = [" ", "~", "x"][int(r.integers(0, 3))] * int(r.integers(0, 2))
            at = int(r.integers(0, len(text)))
            text = text[:at] + "".join(chars) + text[at:]
        if d % 5 == 0:
            text += " exactly16 chars. (short one), short one a"
        text = decontaminate.normal(text)
        got = {h[0] for h in matcher.find(text)}
        for k, passage in items:
            budget = decontaminate.edit_budget(len(passage))
            expected = occurs(passage, text, budget) if len(passage) >= 16 else any(not (text[i - 1 : i] + text[i + len(passage) : i + len(passage) + 1]).replace(" ", "").isalnum() for i in range(len(text)) if text.startswith(passage, i) and not text[i - 1 : i].isalnum() and not text[i + len(passage) : i + len(passage) + 1].isalnum())
            assert (k in got) == expected, (d, k)
            found += expected
    assert found > 30
    twice = decontaminate.Matcher([(50, "short one")]).find('"short one" and short one, not short ones')
    assert [h[1:3] for h in twice] == [(1, 10), (16, 25)]


def test_decontamination_of_long_and_repeated_texts(spark):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    long = f"{prose(2, 30_000)} {prose(1, 30)} {prose(3, 30_000)} {prose(1, 30)}"
    rows = decontaminate.matches(docs(spark, [long, long, "a"], [4, 4, 5]), items).collect()
    assert [r["doc_id"] for r in rows] == [4] * 4 and all(r["edits"] == 0 for r in rows)


def test_decontamination_rows(spark):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, None), (3, ""), (4, "tiny one"), (5, prose(1, 30))], "item_id long, text string")
    table = docs(spark, [None, "", f"{prose(9)} {prose(1, 30)} {prose(8)}", "a tiny one here", prose(7)])
    hits = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, items, most=50).collect())
    assert hits == [(2, 1), (2, 5), (3, 4)]
    left = decontaminate.uncontaminated(table, items)
    assert [r["doc_id"] for r in left.orderBy("doc_id").collect()] == [0, 1, 4] and left.columns == table.columns
    assert decontaminate.matches(table, items.limit(0)).count() == 0


# 3 exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    function = exact_dedup.PerfectHash.build(digests)
    assert sorted(function.slots(digests)) == list(range(n))
    again = exact_dedup.PerfectHash.load(*function.dump())
    assert (again.slots(digests) == function.slots(digests)).all()


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup(spark, share):
    texts = ["a", "b", "a", None, "", "c", "b", "a", "A", "a "]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, texts), history_share=share).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("ids", [[2**60 + 1, 2**60 + 3, 2**60 + 5, None, 2**60 + 7], [1, 2, 3, 4, -(2**62)], [5, 5, 5, 7, 7], [None] * 5])
@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup_keeps_large_and_outlying_ids(spark, ids, share):
    texts = ["a", "b", "a", "x" * 300_000, "b"]
    got = exact_dedup.exact_dedup(docs(spark, texts, ids).withColumn("winner", F.lit(1)).withColumn("shard", F.lit("x")), history_share=share).collect()
    expected = defaultdict(list)
    for i, t in zip(ids, texts):
        expected[t].append(i)
    named = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in g if i is not None), default=None), len(g)) for t, g in expected.items()}
    assert sorted((str(r["doc_id"]), r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted((str(i), h, *named[h], i == named[h][0]) for i, t in zip(ids, texts) for h in [hashlib.sha256(t.encode()).hexdigest()])


def test_history_is_about_its_share_of_rows_whatever_the_ids(spark):
    table = spark.range(4000).select(F.when(F.col("id") == 0, -(10**15)).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert 1500 < exact_dedup.exact_dedup(table).filter("in_history").count() < 2500


def test_exact_dedup_odd_tables(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = exact_dedup.exact_dedup(docs(spark, ["a", "a", "b"], [None, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"] or -1, r["kept"]) for r in rows) == [(False, 3, True), (True, -1, True), (True, 3, False)]


# 4 and 10 classifiers


def test_toxicity_learns_and_locates():
    texts = [f"{prose(i, 20)}. {'you moron. ' if i % 2 else ''}{prose(i + 500, 20)}." for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    clean, bad = prose(901, 30) + ". " + prose(902, 20), prose(903, 30) + ". such a moron. " + prose(904, 20)
    value = lambda t: model.score(np.array([s[2] for s in model.sentences(t)]))
    assert value(clean) < 0.5 < value(bad)
    worst = max(model.sentences(bad), key=lambda s: s[2])
    assert "moron" in bad[worst[0] : worst[1]]
    assert 0 <= value("") <= 1


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, [None, "", "x" * 100_000, "a"])
    rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_from_positives_and_unlabelled():
    good = [prose(i, 40) for i in range(300)]
    junk = [" ".join(f"{w}###" for w in prose(i, 40).split()) for i in range(1000, 1100)]
    shapes = lambda x: np.array([quality.measures(t) for t in x])
    model = quality.train(shapes(good[:150]), shapes(good[150:] + junk), 0.6)
    assert model.score(shapes(good)).min() > model.score(shapes(junk)).max()
    assert len(model.score(shapes(["", "\x00"]))) == 2
    assert 0 <= quality.train(np.empty((0, 23)), np.empty((0, 23)), 0.3).score(shapes(["a"]))[0] <= 1


def test_quality_cuts_are_of_all_documents(spark):
    texts = [prose(i, 20) + "#" * (i % 97) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    values = np.array([quality.measures(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5])
    model = quality.fit(docs(spark, texts), labels, most=20)
    expected = np.quantile(values, quality.QUANTILES, axis=0, method="inverted_cdf").T
    assert np.allclose(model.cuts[:, : expected.shape[1]], expected, rtol=1 / 256, atol=1e-300)


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.mark.parametrize("module,column,least", [(toxicity, "toxic", 0.95), (quality, "quality", 0.95)])
def test_held_out_labels_are_told_apart(spark, module, column, least):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    table, labels = read("documents"), read("labels")
    scored = module.score(table, module.fit(table, labels)).filter("held_out").select("doc_id", "score")
    pairs = [(r["score"], r[column]) for r in scored.join(labels, "doc_id").collect()]
    assert len(pairs) > 50 and auc(pairs) > least


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    texts = [prose(i, 20) if i % 2 else "### " * (i + 1) for i in range(40)] + [None, "", "x" * 500_000]
    table = docs(spark, texts, [*range(40), None, 1, 1])
    model = quality.fit(table, labels)
    rows = quality.score(table, model).collect()
    assert len(rows) == 43 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score(table.limit(0), model).count() == 0
    assert quality.score(table, quality.fit(table.limit(0), labels)).count() == quality.score(table, quality.fit(table, labels.limit(0))).count() == 43


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    texts = [prose(i, 20) + (" you moron." if i % 2 else "") for i in range(60)]
    table = docs(spark, texts + [None, texts[1], texts[1]], [*range(60), None, 1, 1])
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == 63 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert toxicity.score(table.limit(0), model).count() == 0 and toxicity.clean(table, model).columns == table.columns
    assert sum(r["text"] is None for r in toxicity.clean(table, model).collect()) == 1


def test_samples_have_a_bound_in_bytes(spark, monkeypatch):
    from pixelframe.llm import labelled

    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 1000)
    table = docs(spark, ["x" * 300] * 50)
    assert 1 <= len(labelled.unlabelled_sample(table, 40)) <= 3


def test_held_out_rows_are_never_learnt(spark):
    from pixelframe.llm.labelled import labels_for_training

    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert {r["doc_id"] for r in labels_for_training(rows, "toxic").collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


# 5 html


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<p>a  b&amp;c&nbsp;d<br>e<p>f", "a b&c d e\nf"),
        ("<nav>x</nav><article><h1>T</h1><p><b>one<br><p>two</article><footer>y", "T\none\ntwo"),
        ('<script>var a="</p>";</script><article>x<form>y</form><div class="ad">z</div></article>', "x"),
        ("<div class='sidebar'>s</div><main><p>m</p></main><div id=comments>c</div>", "m"),
        ("<!-- <p>no</p> --><p>yes &lt;b&gt; &#233;</p><p", "yes <b> é"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(html_text.hash_trees(html_text.parse(page)), frozenset()) == text


def test_templates_are_removed_but_copied_articles_stay(spark):
    page = lambda i: f"<div>Site slogan</div><div><p>Body {i % 2} of the story</p></div><article><p>Same article</p></article>" if i < 6 else f"<div>Site slogan</div><div>Body {i}</div>"
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", page(i), "x") for i in range(12)] + [(99, None, None, "x")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows, min_share=0.3).collect()}
    assert got[0] == "Same article" and got[7] == "Body 7" and got[99] == ""
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def test_copied_pages_keep_their_main_text(spark):
    wrapped, plain = "<div id=content><article><p>One story, told in full</p></article></div>", "<div><p>Another story</p><p>and how it ends</p></div>"
    pages = [f"<div>Slogan</div>{wrapped}"] * 5 + [f"<div>Slogan</div>{plain}"] * 5 + [f"<div>Slogan</div><p>Page {i} has a text of its own</p>" for i in range(10)]
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows).collect()}
    assert got[0] == "One story, told in full" and got[5] == "Another story\nand how it ends" and got[12] == "Page 2 has a text of its own"


def test_boilerplate_inside_articles_is_removed(spark):
    prose_of = lambda i: f"<p>Story {min(i, 8)} is told here</p>" + ("<p>A quote of three</p>" if i < 3 else "")
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", f"<article><div>Read our terms</div>{prose_of(i)}<p>Write to us</p></article>") for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows).collect()}
    assert got == {i: f"Story {min(i, 8)} is told here" + ("\nA quote of three" if i < 3 else "") for i in range(12)}


def test_names_for_prose_are_no_furniture():
    page = '<article><h2 id="comments-on-method">On method</h2><div class="share-price">Up <span class="alert-level">two</span></div><section id="related-work" data-id="ad">Others</section><div class="cookie-banner">ok?</div><p class="ad">buy</p><div id="comments_list">first!</div></article>'
    assert html_text.main_text(html_text.hash_trees(html_text.parse(page)), frozenset()) == "On method\nUp two\nOthers"


def test_recurring_subtrees_alone_find_the_main_text(spark):
    """No tag, role or class is known here: what a host repeats goes, what its pages say for themselves stays."""
    page = lambda h, i: f"<ul><li>{h} home</li><li>{h} news</li></ul><div><b>{h}</b> tells all</div><div><p>Story {h} {i}</p><p>told by {i % 3}</p></div><div>Write to {h}</div>"
    rows = spark.createDataFrame([(100 * k + i, f"http://{h}.example/{i}", page(h, i)) for k, h in enumerate("ab") for i in range(30)], "page_id long, url string, html string")
    plain = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows, min_share=2.0, lists=False).collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows, min_share=0.4, lists=False).collect()}
    assert got == {100 * k + i: f"Story {h} {i}\ntold by {i % 3}" for k, h in enumerate("ab") for i in range(30)}
    assert all(plain[i].count("\n") == 5 for i in plain)


def test_templates_against_plain_counts(spark):
    """The templates of one host of the given pages, and texts without them, from counts by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", html_text.host_of())
    host = pages.groupBy("host").count().orderBy(F.desc("count"), "host").first()["host"]
    mine = pages.filter(F.col("host") == host).drop("host")
    seen, contents, roots = defaultdict(set), set(), {}
    for r in mine.collect():
        root = roots[r["page_id"]] = html_text.hash_trees(html_text.parse(r["html"] or "", False))
        text = html_text.main_text(root, frozenset(), False)
        contents.add(text)
        for key in html_text.candidates(root):
            seen[key].add(text)
    least = lambda inside: max(html_text.MIN_PAGES, len(contents) * (html_text.INSIDE_SHARE if inside else html_text.MIN_SHARE))
    template = frozenset(k for (k, inside), found in seen.items() if len(found) >= least(inside))
    assert len(template) > 20
    assert set(html_text.site_templates(mine, lists=False).first()["hashes"]) == template
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(mine, lists=False).collect()}
    assert got == {k: html_text.main_text(root, template, False) for k, root in roots.items()}
    assert sum(html_text.main_text(root, frozenset(), False) != got[k] for k, root in roots.items()) > len(roots) / 2


def test_long_and_repeated_pages(spark):
    body = "<p>One line of a long page.</p>" * 20_000
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = spark.createDataFrame([(1, "http://h.example/1", f"<article>{body}</article>"), (1, "http://h.example/1", f"<article>{body}</article>"), (2, "http://h.example/2", deep)], "page_id long, url string, html string")
    got = html_text.extract_pages(rows).collect()
    assert sorted(r["n_chars"] for r in got) == [4, 25 * 20_000 - 1, 25 * 20_000 - 1]


# 6 and 9 tokens

ODD = ["", " ", "\n\n", " lead", "trail ", "don't I'LL we've", "<|endoftext|> x", "a\x1cb", "漢字 mixed é², ½", "İΣς", "x" * 3000, "tab\tand  two"]


@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@given(text=st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text(alphabet="abc 'st\n.,!é1", max_size=40)))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_whole_texts(name, spaces, text):
    codec = _codec(name, spaces)
    expected = np.array(codec.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert codec.encode(text) == expected == codec.encode(text)


_CODECS = {}


def _codec(name, spaces):
    if name not in _CODECS:
        _CODECS[name] = ChunkEncoder(public_tokenizers.path(name), spaces)
    return _CODECS[name]


def orc_footers(spark, path):
    """For each stripe its columns' encodings and the kinds of its streams."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for file in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        if file.getPath().getName().endswith(".orc"):
            reader = jvm.org.apache.orc.OrcFile.createReader(file.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
            rows = reader.rows()
            for stripe in reader.getStripes():
                footer = rows.readStripeFooter(stripe)
                found.append(([str(c.getKind()) for c in footer.getColumnsList()], {str(x.getKind()) for x in footer.getStreamsList()}))
            rows.close()
    return found


def test_repeated_ids_are_dealt_over_files(spark):
    path = new_path(spark, "test-tokens")
    table = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(table, path, public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_files.read_digests(spark, path).orderBy("start").collect()
    assert token_files.open_tokens(spark, path).filter("doc_id = 7").select("_metadata.file_path").distinct().count() > 1
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and len({r["start"] for r in rows}) == 4000
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_token_files(spark):
    texts = [prose(1), None, "", "b c", prose(2)]
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(docs(spark, texts, [5, 3, 9, 3, 1]), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(token_files.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [1, 3, 3, 5, 9]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    codec = _codec("word_bpe_49k.json", False)
    assert rows[0]["ids_crc32"] == zlib.crc32(codec.encode(prose(2)) + np.array([1], "<u4").tobytes())
    one = token_files.open_tokens(spark, path).filter("doc_id = 9")
    assert one.first()["ids"] == [1] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString()
    footers = orc_footers(spark, path)
    assert footers and all(encodings[4] == "DIRECT_V2" and streams >= {"ROW_INDEX", "BLOOM_FILTER_UTF8"} for encodings, streams in footers)
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(docs(spark, []), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_digests(spark, empty).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from(["norm", "dot"]), st.sampled_from([(64, 64, 4096), (64, 3, 4096), (64, 64, 4200)]))
@settings(max_examples=200, deadline=None)
def test_plan_respects_every_capacity(counts, rule, sizes):
    cap = packing.Capacity(*sizes, rule=rule)
    plan = packing.plan_bins(counts, cap)
    bins = defaultdict(list)
    for length, runs in packing._with_offsets(plan).items():
        ranks = []
        for rank, first, n, each, before in runs:
            for k in range(n * each):
                ranks.append(rank + k)
                bins[first + k // each].append((before + k % each * length, length))
        assert sorted(ranks) == list(range(counts[length]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(places) <= cap.documents and sum(n * n for _, n in places) <= cap.cost
    assert len(bins) == plan.sequences == one_by_one(counts, cap)


def one_by_one(counts, cap):
    """How many bins plain best fit opens, piece by piece, longest first."""
    bins = []
    for length in sorted(counts, reverse=True):
        need = (length, 1, length * length)
        for _ in range(counts[length]):
            fits = [(packing._score(b, need, cap), b, k) for k, b in enumerate(bins) if all(n <= r for n, r in zip(need, b))]
            k = min(fits)[2] if fits else len(bins)
            if not fits:
                bins.append((cap.tokens, cap.documents, cap.cost))
            bins[k] = tuple(r - n for n, r in zip(need, bins[k]))
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_of_all_open_bins_wins(rule):
    cap, need, r = packing.Capacity(rule=rule), (5, 1, 25), np.random.default_rng(2)
    near = {(t, 1000, 792_000) for t in (10, 11, 12)}
    for states in [near | {(40, 1023, 80_320)}, *[{(int(r.integers(3, 400)), int(r.integers(0, 1024)), int(r.integers(0, 1 << 20))) for _ in range(30)} for _ in range(50)]]:
        levels = defaultdict(set)
        for s in states:
            levels[s[0]].add(s)
        fits = [s for s in states if all(x >= n for x, n in zip(s, need))]
        assert packing.best_state(sorted(levels), levels, need, cap) == min(fits, key=lambda s: (packing._score(s, need, cap), s))
    if rule == "norm":  # a bin far from the nearest levels wins by what attention costs leave
        assert packing.best_state([10, 11, 12, 40], {t: {s for s in near | {(40, 1023, 80_320)} if s[0] == t} for t in (10, 11, 12, 40)}, need, cap) == (40, 1023, 80_320)


def test_packing(spark):
    texts = [prose(i, 5 + 40 * (i % 9)) for i in range(30)] + [None, "", "x " * 5000]
    rows = packing.packed_documents(docs(spark, texts)).collect()
    codec = _codec("byte_bpe_50k.json", True)
    bins = defaultdict(list)
    for r in rows:
        ids = codec.encode(texts[r["doc_id"]] or "") + np.array([2], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(codec.encode(t or "")) // 4 + 1 for t in texts)
    for places in bins.values():
        assert sum(n for _, n in places) <= 1024 and sorted(places)[0][0] == 0
    assert packing.packed_documents(docs(spark, [])).count() == 0
    assert packing.pieces_of(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_packing_of_repeated_ids_and_odd_texts(spark):
    texts = [prose(1), prose(1), None, "", prose(2, 3000), "x"]
    rows = packing.packed_documents(docs(spark, texts, [1, 1, 1, None, 2, 2])).collect()
    places = defaultdict(list)
    for x in rows:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    codec = _codec("byte_bpe_50k.json", True)
    assert sum(x["length"] for x in rows) == sum(len(codec.encode(t or "")) // 4 + 1 for t in texts)


def test_token_files_of_long_texts(spark):
    path, long = new_path(spark, "test-tokens"), prose(3, 40_000)
    token_files.write_tokens(docs(spark, [long, long], [2, 2]).withColumn("at", F.lit("x")).withColumn("ids", F.lit(0)).withColumn("tie", F.lit(1)), path, public_tokenizers.path("word_bpe_49k.json"))
    codec = _codec("word_bpe_49k.json", False)
    packed = codec.encode(long) + np.array([1], "<u4").tobytes()
    rows = token_files.read_digests(spark, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(2, k * len(packed) // 4, len(packed) // 4, zlib.crc32(packed)) for k in range(2)]


# 7 language model


def tiny_model(seed=3):
    """A vocabulary of 40 units in 9 classes with a network of random numbers."""
    r = np.random.default_rng(seed)
    first = np.array([0, 1, 2, 3, 9, 15, 20, 29, 36, 40])
    own = {b"word%d" % k: u for k, u in enumerate(u for u in range(1, 40) if u not in (8, 14, 39))}
    vocabulary = language_model.Vocabulary(own, {b"aa": 8, "éb".encode(): 14}, 39, np.repeat(np.arange(9), np.diff(first)), first)
    assert vocabulary.of([b"word1", b"baa", "aéb".encode(), b"b", "é".encode(), b"word0"]) == [2, 8, 14, 39, 39, 1]
    net = language_model.Network.start(vocabulary, r.random(40) + 0.1)
    for x in (net.context, net.target, net.bias, net.places, net.classes):
        x += r.standard_normal(x.shape).astype(np.float32)
    return vocabulary, net


def test_probabilities_add_up_and_agree_with_plain_sums():
    vocabulary, net = tiny_model()
    moved, targets = net.moved(), np.arange(40)
    for one, two in [(0, 0), (3, 17), (39, 8)]:
        got = net.log_probabilities(vocabulary, moved, np.full(40, one), np.full(40, two), targets)
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-5)
        guess = [sum(float(net.context[one, k] * net.places[0][k, j] + net.context[two, k] * net.places[1][k, j]) for k in range(language_model.DIMENSION)) for j in range(language_model.DIMENSION)]
        score = lambda vector, bias: np.exp(sum(g * float(x) for g, x in zip(guess, vector)) + float(bias))
        classes = [score(c[:-1], c[-1]) for c in net.classes]
        for unit in targets:
            c = vocabulary.class_of[unit]
            inside = [score(net.target[u], net.bias[u]) for u in targets if vocabulary.class_of[u] == c]
            assert got[unit] == pytest.approx(np.log(classes[c] / sum(classes) * score(net.target[unit], net.bias[unit]) / sum(inside)), abs=1e-3)


@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85\u3000İΣéA", max_size=12), max_size=5))
@settings(max_examples=100, deadline=None)
def test_words_are_numbered_in_order(texts):
    words = language_model.Words()
    sizes, codes = words.read(texts)
    expected = [language_model.words_of(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in expected] and [words.known[k] for k in codes] == [w for x in expected for w in x]
    values, at = language_model.placed(sizes, codes + 1, 0)
    assert values[at].tolist() == [v for x in expected for v in [*[words[w] + 1 for w in x], 0]]
    assert all(values[k - 2] == 0 and values[k - 1] == 0 for k in np.cumsum(sizes + 3) - sizes - 1)


def test_distinct_words_are_looked_up_once():
    """Whatever the number of tokens, with the same words, units and known numbers as word by word."""
    import pyarrow as pa

    texts = [" baa  B\x0baéb \n", "", " ", "word1 BAA\x85 word1 é " * 1000, "Éa\x1cB"]
    expected = [language_model.words_of(t) for t in texts]
    for found in (texts, pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x x", *texts]).slice(1)):
        sizes, codes, words = language_model.split(found)
        known = language_model.bytes_of(words)
        assert sizes.tolist() == [len(x) for x in expected] and [known[k] for k in codes] == [w for x in expected for w in x]
        assert len(known) == len(set(known)) == 7
    vocabulary, _ = tiny_model()
    by_hand = lambda w: vocabulary.own.get(w, vocabulary.endings.get(language_model.ending(w), vocabulary.rest))
    assert vocabulary.units_of(words).tolist() == [by_hand(w) for w in known]
    assert language_model.numbers({b"b": 5}, words).tolist() == [5 if w == b"b" else -1 for w in known]
    empty = language_model.split([])
    assert [len(x) for x in empty] == [0, 0, 0] and vocabulary.units_of(empty[2]).tolist() == []


def test_noise_contrastive_steps_learn_what_follows():
    vocabulary, _ = tiny_model()
    r = np.random.default_rng(5)
    one = r.integers(0, 40, 30_000)
    two = r.integers(0, 40, 30_000)
    target = (two * 7 + 3) % 40
    noise = np.bincount(target, minlength=40) + 0.5
    net = language_model.Network.start(vocabulary, noise)
    score = lambda: net.log_probabilities(vocabulary, net.moved(), one[:500], two[:500], target[:500]).mean()
    before = score()
    units, _, changed = language_model.train_shard(net, vocabulary, noise, one, two, target, 1, 6)
    net.context[units] += changed.context
    net.target[units] += changed.target
    net.bias[units] += changed.bias
    net.places += changed.places
    net.classes += changed.classes
    assert before < -3.4 and score() > -1.0


@pytest.mark.parametrize("fan", [2, 64])
def test_changes_are_averaged_by_weight_at_any_level(spark, fan):
    r, dim = np.random.default_rng(6), language_model.DIMENSION
    rows, sums, total, gained = [], np.zeros((10, 2 * dim + 1)), np.zeros(10), np.zeros((10, 3))
    for shard in range(9):
        units = np.sort(r.choice(10, 6, replace=False)).astype(np.int32)
        weights, vectors, others = (r.integers(1, 50, 6)).astype(np.float32), r.standard_normal((6, 2 * dim)).astype(np.float16), r.random((6, 4)).astype(np.float32)
        rows.append((3, shard, *[bytearray(x.tobytes()) for x in (units, weights, vectors, others)]))
        sums[units] += weights[:, None] * np.concatenate((vectors, others[:, :1]), axis=1)
        total[units] += weights
        gained[units] += others[:, 1:]
    (got,) = language_model.averaged(spark.createDataFrame(rows, language_model.CHANGES), 9, fan).collect()
    units = np.frombuffer(got["units"], np.int32)
    others = np.frombuffer(got["others"], np.float32).reshape(-1, 4)
    assert units.tolist() == np.flatnonzero(total).tolist() and np.frombuffer(got["weights"], np.float32).tolist() == total[units].tolist()
    assert np.allclose(np.frombuffer(got["vectors"], np.float16).reshape(len(units), -1), (sums[:, :-1] / total[:, None])[units], atol=0.01)
    assert np.allclose(others[:, 0], (sums[:, -1] / total)[units], atol=1e-5) and np.allclose(others[:, 1:], gained[units], atol=1e-5)


def test_language_model_scores_by_hand(spark):
    """The query's score from its own vocabulary and network, token by token."""
    texts = [prose(i, 25) for i in range(60)] + ["", "never seen words"]
    table, kept = docs(spark, texts), {}
    real = language_model.fit_network
    try:
        language_model.fit_network = lambda learnt, vocabulary, tokens: kept.update(v=vocabulary, t=tokens, n=real(learnt, vocabulary, tokens, 1)) or kept["n"]
        rows = {r["doc_id"]: r["score"] for r in language_model.score_documents(table, least=4).collect()}
    finally:
        language_model.fit_network = real
    v, net, counts = kept["v"], kept["n"], Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().lower().split())
    assert v.size == 1 + sum(n >= 4 for n in counts.values()) + len(v.endings) + 1
    for i, text in enumerate(texts):
        words = [*text.encode().lower().split(), b""]
        units = [0, 0, *v.of(words[:-1]), 0]
        logs = net.log_probabilities(v, net.moved(), *(np.array(units[k : len(units) - 2 + k]) for k in range(3)))
        total = 0.0
        for word, unit, log in zip(words, units[2:], logs):
            total += log / np.log(10)
            if unit in v.shared:
                inside = [n for w, n in counts.items() if n < 4 and v.of([w]) == [unit]]
                unknown = min((sum(n == 1 for n in inside) + 0.5) / (sum(inside) + 1), 0.9) if inside else 1.0
                total += np.log10((1 - unknown) * counts[word] / sum(inside)) if word in counts else np.log10(unknown)
        assert rows[i] == pytest.approx(total, abs=1e-4)


def test_language_model_odd_tables(spark):
    assert language_model.score_documents(docs(spark, [])).count() == 0
    untrained = language_model.score_documents(docs(spark, ["a b", None, "x " * 50_000], [1, None, 1]), F.lit(False)).collect()
    assert sorted(r["n_tokens"] for r in untrained) == [1, 3, 50_001] and all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in untrained)


def test_language_model_beats_its_base_on_held_out_documents(spark):
    rows = language_model.op7_log_bilinear(spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert rows["score"] > rows["base"]


def test_language_model_rows(spark):
    texts = [prose(i, 30) for i in range(40)] + [None, "", "unseen-word-zz"]
    rows = {r["doc_id"]: r for r in language_model.score_documents(docs(spark, texts)).collect()}
    ho = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    known = defaultdict(int)
    for i, t in enumerate(texts):
        if not ho(i):
            for w in (t or "").encode().lower().split() + [b""]:
                known[w] += 1
    total, distinct = sum(known.values()), len(known)
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split() + [b""]
        base = sum(np.log10((known.get(w, 0) + 1) / (total + distinct + 1)) for w in words)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(w in known for w in words), total, ho(i))
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def test_units_grow_with_the_corpus_and_words_have_contexts_of_their_own(spark):
    # 300 pairs of words, all as frequent and all of one ending: only vectors of their own tell which follows which
    texts = [" ".join(f"first{k:03d}xx second{k:03d}xx filler" for k in np.random.default_rng(i).permutation(300)) for i in range(400)]
    table = docs(spark, texts)
    counts = language_model.count_words(table)
    sizes = [language_model.choose_vocabulary(counts.filter(F.col("word") < w), 10)[0].size for w in (b"first100xx", b"t")]
    assert sizes == [1 + 101 + 1, 1 + 601 + 1]
    good = " ".join(f"first{k:03d}xx second{k:03d}xx filler" for k in range(200, 300))
    bad = " ".join(f"first{k:03d}xx second{(k + 7) % 100 + 200:03d}xx filler" for k in range(200, 300))
    rows = {r["doc_id"]: r for r in language_model.score_documents(docs(spark, [*texts, good, bad]), F.col("doc_id") < 400, 10).collect()}
    assert rows[400]["score"] > rows[401]["score"] + 4 and rows[400]["base_score"] == pytest.approx(rows[401]["base_score"])


# 8 near dedup and components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


def test_near_dedup_against_brute_force(spark):
    texts = []
    for g in range(12):
        words = prose(g, 80).split()
        r = np.random.default_rng(g)
        for k in range(8):
            w = list(words)
            for _ in range(int(r.integers(0, 9))):
                w[int(r.integers(0, len(w)))] = f"new{r.integers(0, 1000)}"
            texts.append(" ".join(w))
    texts += [None, "", "   ", "one", "ONE", "one two", "two one", texts[0].upper(), texts[0]]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in range(len(texts))}


def test_pairs_within_distance_share_a_key():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 1 << 16, near_dedup.SYMBOLS)
        b = a.copy()
        b[r.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] ^= 1
        assert any(all(a[i] == b[i] for i in kept) for kept in near_dedup.KEYS)


def test_near_dedup_of_given_documents(spark):
    """All classes of the given documents against an exact join over shared shingles."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in holders[x])
        for j, both in shared.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders[x].append(i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.op8_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in sets}


def test_near_dedup_of_shared_ids_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_BYTES", 2000)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)  # all links come from tiles
    one, two, three = prose(1, 100), prose(2, 100), prose(3, 100)
    texts = [one, one + " more", two, two + " more", three, one, "long " * 200_000, prose(4, 40), prose(4, 40) + " end"]
    ids = [10, 11, 12, 13, 11, 10, 20, 30, 31]  # 11 has two texts
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_dedup(docs(spark, texts, ids).drop("digest", "id")).collect()}
    assert {i: c for (i, _), c in got.items()} == {10: 10, 11: 10, 12: 12, 13: 12, 20: 20, 30: 30, 31: 30}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("near_sets_")]


def test_components_of_a_star_and_of_nothing(spark, monkeypatch):
    from pixelframe.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)  # the centre goes by broadcast
    edges = spark.createDataFrame([(i, 1000) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in [*range(200), 1000]} | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0
    assert [r["kept"] for r in near_dedup.near_dedup(docs(spark, ["a b c", "a b c"], [None, None])).collect()] == [True, True]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}


@pytest.mark.parametrize("most", [0, 10])
def test_without_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    from pixelframe.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    table = docs(spark, [str(i) for i in range(20)])
    left = without(table, spark.range(0, 20, 3).select(F.col("id").alias("doc_id")))
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(20) if i % 3] and left.columns == table.columns


def test_an_id_stays_while_one_of_its_texts_does(spark):
    marks = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (None, False)], "doc_id long, kept boolean")
    assert sorted(str(r["doc_id"]) for r in rejected(marks).collect()) == ["2", "None"]


def test_without_keeps_null_ids(spark):
    table = docs(spark, ["a", "b", "c"], [1, None, 2])
    left = without(table, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert sorted(r["text"] for r in left.collect()) == ["b", "c"] and left.columns == table.columns
