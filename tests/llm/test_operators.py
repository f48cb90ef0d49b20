"""Token counts, quality model, chat format, mixing and decontamination."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm.chat_format import PART, format_chat, read_back, text_parts
from opslens.llm.quality_gam import Gam, fit, fit_quality, score_quality
from opslens.llm.source_mixing import mix_sources
from opslens.llm.template_decontam import leaked_items, template
from opslens.llm.textarrays import blocks
from opslens.llm.token_counts import WordCounter, prefix_token_counts, truncate, word_prefix_counts

from .conftest import EDGES, corpus

TRICKY = ["", None, "a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|> x", "don't. it's, x's' 'tis O'NEIL?! a.b foo... 5. 12,5 é, é.a --- <|",
          "İstanbul ΣΑΣ ẞ ﬁ x́ ́y  z w\x85v\x1cu", "\x0b\x0c\t tab\r\nline", "日本語 テスト 😀😀!", "x" * 5000, "!" * 300, "a  b" * 200]


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_are_the_librarys(frame, tokenizer):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer)
    rows = [*corpus(21), *[(1000 + i, t) for i, t in enumerate(TRICKY)]]
    want = {d: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows}
    got = prefix_token_counts(frame(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    text = dict(rows)
    for r in got[::9]:
        for end, count in list(zip(r.ends, r.counts))[::7]:
            assert count == len(library.encode(text[r.doc_id].encode()[:end].decode(), add_special_tokens=False))


def test_words_without_or_with_several_ends_do_not_shift_counts(frame, tokenizer):
    """Blanks beyond ASCII are words without tokens, marks and blanks inside a word give it several ends; one of each cancels out."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer)
    ends = [("\u00a0", "bar\u2019"), ("\u3000", "gar\u00e7on\u00a0bleu"), ("\u2028", "na\u00efve\u2014caf\u00e9"), ("\u0085", "\u65e5\u672c\u3002\u8a9e")]
    rows = [(d, f"extraordinarily {none} multidimensional {several} foo internationalization") for d, (none, several) in enumerate(ends)]
    rows.append((9, " ".join(w for _, t in rows for w in t.split(" "))))
    for r in prefix_token_counts(frame(rows, 1)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id])
        each = [len(library.encode(w, add_special_tokens=False)) for w in words]
        assert r.counts == np.cumsum(each).tolist() and r.n_tokens == len(library.encode(dict(rows)[r.doc_id], add_special_tokens=False))
    got = WordCounter(tokenizer)
    packed = ["extraordinarily", "\u00a0", "multidimensional", "bar\u2019", "foo"]
    data = np.frombuffer(" ".join(packed).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) + 1 for w in packed]) - 1
    assert got.counts(data, end - [len(w.encode()) for w in packed], end).tolist() == [2, 0, 2, 3, 1]


def test_truncation_needs_no_encoding(frame, tokenizer):
    counter = WordCounter(tokenizer)
    rows = corpus(22, 20)
    for r in truncate(prefix_token_counts(frame(rows)), 17).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        best = max([k for k in range(len(words) + 1) if k == 0 or counter.encode(words[:k]).sum() <= 17])
        assert (r.cut_tokens, r.cut_bytes) == (counter.encode(words[:best]).sum() if best else 0, r.ends[best - 1] if best else 0)
    assert word_prefix_counts(counter, "thanes").tolist() == [0, *[int(counter.encode(["thanes"[:k]])[0]) for k in range(1, 7)]]


def test_token_counts_edges(frame, tokenizer):
    assert prefix_token_counts(frame([])).collect() == []
    got = prefix_token_counts(frame(EDGES)).collect()
    assert len(got) == len(EDGES) and sum(r.doc_id is None for r in got) == 2
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (7, 8)} == {(0, 0)}


def test_gam_learns_and_round_trips():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 18))
    y = ((x[:, 5] > 0.5) ^ (x[:, 6] > 0.5)).astype(float)  # no feature tells anything alone, the pair everything
    model = fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.93
    assert {(f, g) for f, g, *_ in model.pairs} & {(6, 5)}
    assert np.allclose(Gam.from_json(model.to_json()).score(x), model.score(x))


def test_quality_query_held_out(spark):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.01"
    out = E.queries()["op4_quality_classifier"](spark, d)
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    again = {r.doc_id: r.score for r in E.queries()["op4_quality_classifier"](spark, d).collect()}
    assert {r.doc_id: r.score for r in out.collect()} == again


def test_quality_edges(spark, frame):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, None), (5, 0), (9, 7), (None, 1)], "doc_id long, quality int")
    model = fit_quality(frame(EDGES), labels)
    got = score_quality(frame(EDGES), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert score_quality(frame([]), Gam()).collect() == []
    none = fit_quality(frame(EDGES), labels.limit(0))
    assert {r.score for r in score_quality(frame(EDGES), none).collect()} == {0.5}


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok<|im_end|>", "\\", "\\\\<|", "<\\|x", "", None, "a\nb\\\n", "é😀<|", "|<", "<"]
    rows = [(c, t, role, texts[(c * 3 + t) % len(texts)]) for c in range(6) for t, role in
            enumerate(["system", "user", "assistant", "user", "assistant", "role\nwith \\ newline<|", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = read_back(format_chat(df.withColumn("parts", text_parts(F.col("text"))))).collect()
    assert len(out) == 6
    for r in out:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(m.role, m.text) for m in r.messages] == [(x[2] or "", x[3] or "") for x in mine]
        assert list(r.masked) == [x[3] or "" for x in mine if x[2] == "assistant"]
        for span in r.loss:
            assert r.formatted[span.start - 1] == "\n" and r.formatted[span.start + span.length:].startswith("<|im_end|>\n")


def test_chat_parts(spark):
    parts = "array(named_struct('type','text','text','see <|','ref',null,'units',null), named_struct('type','image','text',null,'ref','a.png','units',2)," \
            "named_struct('type','audio','text',null,'ref','b.wav','units',4), named_struct('type','video','text',null,'ref','c','units',1), cast(null as " + PART + "))"
    df = spark.range(1).selectExpr("id as conv_id", "0L as turn", "'user' as role", f"{parts} as parts") \
        .union(spark.range(1).selectExpr("id", "1L", "'assistant'", f"cast(null as array<{PART}>)"))
    r = format_chat(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|<|image|><|audio|><|attachment|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 512), (0, 2, "audio", "b.wav", 100), (0, 3, "video", "c", 0)]
    assert r.attachment_tokens == 612


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert format_chat(empty.withColumn("parts", text_parts(F.col("text")))).collect() == []
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a")]
    out = {r.conv_id: [m.text for m in r.messages] for r in
           read_back(format_chat(spark.createDataFrame(rows, schema).withColumn("parts", text_parts(F.col("text"))))).collect()}
    assert out == {None: ["y", "x"], 1: ["a", "a", "b"]}


def water(sizes, weights, cap):
    """Targets by the plain rule: share out, stop the full ones, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if cap * sizes[s] <= weight[s] * level}
        for s in full:
            target[s] = cap * sizes[s]
        if not full:
            return target | {s: weight[s] * level for s in free}
        free -= full
        left -= sum(cap * sizes[s] for s in full)
    return target


def test_mixing(frame):
    rows = corpus(31, 150)
    df = frame(rows)
    source = {r.doc_id: r.source for r in df.collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows}
    sizes = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    want = water(sizes, (5, 2, 1), 3)
    got = mix_sources(df).collect()
    assert {r.doc_id: r["size"] for r in got} == size
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.5
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted(got, key=str) == sorted(mix_sources(df.repartition(7)).collect(), key=str)
    assert sorted(got, key=str) != sorted(mix_sources(df, seed=1).collect(), key=str)


def test_mixing_inclusion_is_unbiased(spark):
    """Documents of one source and size are taken equally often over many seeds."""
    df = spark.createDataFrame([(i, "a b", "s" if i < 20 else "t") for i in range(40)], "doc_id long, text string, source string").cache()
    counts = np.zeros(20)
    for seed in range(12):
        for r in mix_sources(df, weights=(3, 2), seed=seed).collect():
            if r.source == "t":
                counts[r.doc_id - 20] += r.taken
    assert counts.sum() == 12 * 32 and counts.std() < 6


def test_mixing_edges(frame):
    assert mix_sources(frame([])).collect() == []
    got = mix_sources(frame(EDGES)).collect()
    assert len(got) == len(EDGES) and sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert all(r.taken == 0 for r in mix_sources(frame([(1, None), (2, "")])).collect())


ITEM = "A train leaves the station at 40 km and returns after 40 minutes carrying Maria and 12 boxes for Maria today."


def test_decontamination(spark, frame):
    bench = spark.createDataFrame([(1, ITEM), (2, "five words make an item"), (3, "too short"), (4, None), (5, ITEM)], "item_id long, text string")
    filler = " ".join(f"word{i}x filler" for i in range(50))
    rows = [(10, f"{filler} {ITEM} {filler}"),
            (11, f"{filler}. " + ITEM.replace("40", "55").replace("Maria", "Helen")),           # other parameters, used alike
            (12, f"{filler}. " + ITEM.replace("at 40 km", "at 7 km").replace("12", "13")),       # 40 stands for 7 and for 40
            (13, ITEM.upper().replace(" ", "!! ")), (14, filler), (15, "say five words make an item, please"), (16, None), (17, "five words make"),
            (18, " ".join(ITEM.split()[:9])), (None, ITEM), (20, ITEM), (20, ITEM)]
    out = leaked_items(frame(rows), bench).collect()
    got = {(r.doc_id, r.item_id): r.reparameterised for r in out}
    assert {k for k in got if k[1] == 1} == {(10, 1), (11, 1), (13, 1), (None, 1), (20, 1)}
    assert got[(11, 1)] and not got[(10, 1)]
    assert {k for k in got if k[1] != 1} == {(d, 5) for d in (10, 11, 13, None, 20)} | {(15, 2)}
    joined = leaked_items(frame(rows), bench, max_sent=0).collect()  # the way beyond the broadcast bound
    assert sorted(map(str, joined)) == sorted(map(str, out))


def test_decontamination_edges(spark, frame):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaked_items(frame([]), bench).collect() == []
    assert leaked_items(frame(EDGES), bench.limit(0)).collect() == []
    assert leaked_items(frame(EDGES), bench).collect() == []


def test_decontamination_keeps_verbatim_windows_beside_a_conflict(spark, frame):
    """A value that stands twice in an item and is changed once costs the windows around the change, not the alignment."""
    tail = "in the morning and then walks slowly home along the old river road to see a friend"
    items = {1: f"Yesterday Tom buys 2 apples and 2 pears {tail}", 2: f"Here is Tom and there is his friend Tom {tail}"}
    bench = spark.createDataFrame([*items.items(), (3, ITEM)], "item_id long, text string")
    row12 = ITEM.replace("at 40 km", "at 7 km").replace("12", "13")
    rows = [(1, items[1].replace("2 apples", "3 apples")), (2, items[2].replace("is Tom", "is Tim")), (3, row12)]
    out = {(r.doc_id, r.item_id): (r.n_windows, r.reparameterised) for r in leaked_items(frame(rows), bench, min_windows=1).collect()}
    n = len(items[1].split()) - 7
    assert out[1, 1] == (n - 4, False)                                   # the four windows that hold the 3
    assert out[2, 2] == (len(items[2].split()) - 7 - 3, False)           # the three that hold Tim
    assert out[3, 3] == (4, True)                                        # two verbatim, two with 13 for 12 alone: too few by default
    assert {(r.doc_id, r.item_id) for r in leaked_items(frame(rows), bench).collect()} >= {(1, 1), (2, 2)}


def test_decontamination_in_other_contexts(spark, frame):
    """Case, line breaks, marks and the place in a sentence decide what is a name, not what is found."""
    long = "Yesterday Maria met Helen. They saw Paul near Rome. Then Anna and Peter went home by train. Later Clara and Victor came to see Berlin."
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "What is 3 plus 4 times 5?"), (3, long)], "item_id long, text string")
    rows = [(1, "please answer What is the capital of France"), (2, "please answer What is 7 plus 4 times 9 now"), (3, "he said: " + long.lower()),
            (4, "and so " + long.replace(".", "")), (5, long.replace(" ", "\n")), (6, "Paris is the capital of France."), (7, "please answer What is 7 plus 4 and 9")]
    out = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.reparameterised) for r in leaked_items(frame(rows), bench).collect()}
    n = len(long.split()) - 7
    assert out == {(1, 1): (1, 1, False), (2, 2): (1, 1, True), **{(d, 3): (n, n, False) for d in (3, 4, 5)}}
    joined = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.reparameterised) for r in leaked_items(frame(rows), bench, max_sent=0).collect()}
    assert joined == out


def test_template_does_not_look_into_the_document_before():
    """A text's tokens are its own, whatever stands before it in the batch."""
    def tokens(*texts):
        forms, first, *_ = template(next(blocks(pa.array(texts))))
        return [token[first[-2]:].tolist() for token, _, _ in forms]

    for text in ("Day trips to old towns", "A 5 km walk", "In 3 days"):
        assert tokens("it costs 5", text) == tokens("it costs 5", "", text) == tokens(text)
