"""Exact search against brute force, reading of messages, and held-out accuracy."""

import base64
import quopri

import numpy as np
import pyarrow as pa
import pytest

from strataweave.llm import review
from strataweave.llm.calibration import Calibration, copies, fold_of, reliability
from strataweave.llm.mailtext import fold, passages
from strataweave.llm.neighbours import BlockMaxIndex, tf_idf
from strataweave.llm.review import THRESHOLD, Labelled, Seen, Words, fit, labelled_sample, learn_words, rates, scores


def vectors(rng, n, terms):
    rows = [rng.choice(terms, rng.integers(0, 9)) if i % 11 else [] for i in range(n)]
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    term = np.concatenate([np.asarray(r, np.int64) for r in rows])
    return tf_idf(start, term, np.r_[rng.random(terms - 20) * 5 + 0.1, 3.0])


@pytest.mark.parametrize(("k", "floor"), [(1, 0.3), (5, 0.0001), (7, 0.4), (200, 0.2)])
def test_index_equals_brute_force(k, floor):
    rng = np.random.default_rng(k)
    terms = 120
    examples, queries = vectors(rng, 700, terms), vectors(rng, 150, terms)
    dense = lambda v: np.stack([np.bincount(v.term[a:b], v.weight[a:b], terms) for a, b in zip(v.start, v.start[1:], strict=False)])
    cos = dense(queries) @ dense(examples).T
    got = BlockMaxIndex(examples, terms).search(queries, k, floor)
    for q in range(150):
        mine = got.cosine[got.query == q]
        want = np.sort(cos[q][cos[q] >= floor])[::-1][:k]
        assert np.allclose(mine, want, atol=1e-6)
        assert np.allclose(cos[q][got.example[got.query == q]], mine)


def test_index_without_examples():
    none = tf_idf(np.array([0]), np.zeros(0, np.int64), np.array([1.0, 1.0]))
    one = tf_idf(np.array([0, 1]), np.zeros(1, np.int64), np.array([1.0, 1.0]))
    assert not len(BlockMaxIndex(none, 1).search(one, 3, 0.1).query)
    assert not len(BlockMaxIndex(one, 1).search(none, 3, 0.1).query)


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [
        ("Stupid g00se", "stupid gose"), ("s t u p i d goose", "stupid gose"), ("s-t-u-p-i-d goose", "stupid gose"), ("stuuuupid goooose", "stupid gose"), ("sTuPiD GOOSE", "stupid gose"),
        ("ѕtuріd gооsе", "stupid gose"), ("stu​pid g­o­ose", "stupid gose"), ("ｓｔｕｐｉｄ goose", "stupid gose"), ("stùpïd goose", "stupid gose"),
    ],
)
def test_fold(disguised, plain):
    assert fold(disguised).split() == plain.split()


def test_near_words():
    w = Words(["dimwit", "scoundrel", "you", "drop", "dead", "a", "useles"])
    of = lambda x: [w.known[i] for i in w.numbers(x)]
    assert of("dmiwit") == of("d*mwit") == of("dimwt") == of("dimwitt") == ["dimwit"]
    assert of("drop*dead") == ["drop", "dead"] and of("auselesdimwit") == ["a", "useles", "dimwit"] and of("zebra") == []
    start, ids = w.encode(pa.array(["you dmiwit", "", "drop*dead zebra"]))
    assert start.tolist()[0] == 0 and ids[:2].tolist() == [2, 0] and ids[-3:].tolist() == [3, 4, 7]


LINE = "You are a stupid goose, café."
PART = {
    "base64": base64.encodebytes(LINE.encode()).decode(),
    "quoted-printable": quopri.encodestring(LINE.encode()).decode(),
    "8bit": LINE,
}


@pytest.mark.parametrize("encoding", PART)
def test_parts(encoding):
    text = f"Subject: =?utf-8?B?{base64.b64encode('Grüße dort'.encode()).decode()}?=\r\nContent-Type: multipart/mixed; boundary=\"bb\"\r\n\r\npre\r\n--bb\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: {encoding}\r\n\r\n{PART[encoding]}\r\n--bb\r\nContent-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8gd29ybGQ=\r\n--bb--\r\n"
    found = {" ".join(p) for p in passages(text)}
    assert "you are a stupid gose cafe" in found and "gruse dort" in found and not any("helo world" in p for p in found)


def test_html_quotes_wraps_and_broken_input():
    assert ("you", "are", "a", "stupid", "gose", "my", "friend") in passages("From: a\n\n> You are a stupid\n> goose my friend.\n")
    assert ("stupid", "gose") in passages("From: a\nContent-Type: text/html\n\n<html><style>x{}</style><p>Stupid&nbsp;<b>goose</b>.</p></html>")
    assert ("cafe", "gose", "here") in passages("From: a\n\nCafÃ© goose here.")
    for odd in (None, "", " ", "\n\n", ":", "From: a", "Content-Type: multipart/mixed; boundary=\"x\"\n\n--x\n--x--", "Content-Transfer-Encoding: base64\n\n@@@", "\x00"):
        assert isinstance(passages(odd), dict)


@pytest.mark.parametrize("piece", ["a", "A1", " ", "\n", "a ", "@", "a@", "<", "<!--", "<script>", "> ", "=", "=\n", "Zg==", ".", "\u00e9", "--x\n", "! ", "?", "*a"])
def test_time_in_proportion(piece):
    import time

    took = {}
    for n in (50_000, 400_000):
        text = "Subject: x\nContent-Type: text/html; boundary=x\n\n<html>" + piece * (n // len(piece)) + " end"
        t = time.process_time()
        passages(text)
        took[n] = time.process_time() - t
    assert took[400_000] < 24 * max(took[50_000], 0.02)


BENIGN = ["The pallet is stuck in hall {n}.", "Please send the invoice before noon {n}.", "We moved the replica to shelf {n}.", "You are a great help with crate {n}.", "The goose farm ordered {n} crates.", "Lunch is served in room {n} at one."]
BAD = {"abusive": ["You are a stupid goose and nobody likes you.", "Shut your mouth, you worthless dimwit."], "hateful": ["The Zorbians are vermin and must go.", "Never trust a Zorbian, they all steal."], "sexual": ["I want you naked in my bed tonight.", "Send me nude pictures of you, darling."]}


def corpus(rng, n):
    rows, truth = [], {}
    for i in range(n):
        lines = [rng.choice(BENIGN).format(n=rng.integers(1, 900)) for _ in range(5)]
        kind = rng.choice([None, None, None, "abusive", "hateful", "sexual"])
        if kind:
            lines.insert(int(rng.integers(0, 5)), str(rng.choice(BAD[kind])))
        rows.append((i, str(rng.choice(["S1", " s1", "s2"])), "Subject: note\nFrom: x\n\n" + "\n".join(lines), 1.0, "v"))
        truth[i] = kind or "ok"
    return rows, truth


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    rows, truth = corpus(rng, 600)
    rows += [(9001, "s2", None, 1.0, ""), (9002, None, "", 1.0, ""), (9003, "s2", "You are a stupid goose and nobody likes you. " + "The pallet is stuck in hall 5. " * 20_000, 1.0, ""), (9003, "s2", "x", 1.0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, score double, verdict string").repartition(4)
    labelled = list(range(0, 600, 2))
    labels = [(i, (truth[i] if rng.random() > 0.05 else "ok").upper() if i % 3 else truth[i]) for i in labelled] + [(1, None), (3, "unsure"), (None, "ok"), (5, "ok"), (5, "abusive")]
    out = scores(docs, spark.createDataFrame(labels, "doc_id long, verdict string"))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    held = [i for i in range(1, 600, 2)]
    assert all((got[i][0]["score"] >= THRESHOLD) == (truth[i] != "ok") for i in held)
    assert all(got[i][0]["verdict"] == truth[i] for i in held if truth[i] != "ok")
    assert got[9001][0]["score"] == got[9002][0]["score"] == 0 and got[9001][0]["evidence"] is None
    assert sorted(r["score"] >= THRESHOLD for r in got[9003]) == [False, True]
    by = {r["source"]: r for r in rates(out).collect()}
    assert set(by) == {"s1", "s2", None} and by[None]["n_docs"] == 1 and sum(r["n_docs"] for r in by.values()) == 604


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "s", "You are a goose.")], "doc_id long, source string, text string")
    none = spark.createDataFrame([], "doc_id long, verdict string")
    assert [r["score"] for r in scores(docs, none).collect()] == [0.0]
    assert scores(docs.limit(0), none).count() == 0


def test_bounds_of_the_sample_keep_the_balance_of_the_labels(spark, monkeypatch):
    """One positive document for two clean ones with the same phrase: no case, with and without bounds that act."""
    phrase = "the zorbian gadget rattles loudly"
    own = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}") + "quux"
    read = spark.createDataFrame([(i, [phrase, f"{own(i)} {own(i + 5000)}"]) for i in range(300)], "doc_id long, passages array<string>")
    labels = spark.createDataFrame([(i, "abusive" if i % 3 == 0 else "ok") for i in range(300)], "doc_id long, verdict string")
    got = []
    for bounds in ((5_000, 8_000), (80, 40)):
        monkeypatch.setattr(review, "MAX_POSITIVE", bounds[0])
        monkeypatch.setattr(review, "MAX_CLEAN", bounds[1])
        sample = labelled_sample(read, labels)
        assert sum(d.weight for d in sample if d.verdict) == pytest.approx(100) and sum(d.weight for d in sample if not d.verdict) == pytest.approx(200)
        # The phrase as another example of its own, so that the vote on it is seen.
        words = learn_words(sample)
        model = fit(sample, words, np.full(len(words.known), 3), 300, [Labelled("abusive", [phrase])])
        got.append(model.score(pa.array([phrase]))[0][0])
    assert got[0] == pytest.approx(got[1], abs=0.02) and max(got) < THRESHOLD


def test_last_word_is_kept():
    assert ("you", "are", "an", "idiot") in passages("From: a\n\nYou are an idiot")
    assert ("idiot",) in passages("From: a\nSubject: hello\n\nIdiot")


def test_words_in_a_long_passage_are_found():
    """A word of idf 8 among 60 others of idf 3: cosine 0.33 in the whole passage, below the floor."""
    others = [f"{c}{v}t{w}" for c in "bdfgklmn" for v in "aeiou" for w in "ai"][:60]
    sample = [Labelled("abusive", ["dimwit"])] * 3 + [Labelled("", others)] * 2
    words = learn_words(sample)
    model = fit(sample, words, np.array([30 if w == "dimwit" else 5_000 for w in words.known]), 100_000)
    for at in (0, 17, 30, 59, 60):
        text = "From: a\n\n" + " ".join([*others[:at], "dimwit", *others[at:]])
        texts = [" ".join(p) for p in passages(text)]
        score = model.score(pa.array(texts))[0]
        assert len(texts[0].split()) == 61 and score[0] == 0 and score.max() >= THRESHOLD
        assert set(" ".join(texts[1:]).split()) == {"dimwit", *others}


def _encoded(raw, charset="utf-8", kind="text/plain"):
    return f"From: a\nContent-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(raw).decode()}"


@pytest.mark.parametrize(("charset", "codec"), [("utf-16", "utf-16"), ("utf-16", "utf-16-be"), ("UTF-16", "utf-16-le"), ("utf-16le", "utf-16-le"), ("utf-8", "utf-16"), ("utf-32", "utf-32-le"), ("utf-16", "utf-8")])
def test_wide_charsets(charset, codec):
    assert tuple("you are a stupid gose cafe".split()) in passages(_encoded(LINE.encode(codec), charset))


def test_whole_part_decides():
    start = b"\x01" * 300 + b"\n\n"
    assert ("you", "are", "a", "stupid", "gose", "cafe") in passages(_encoded(start + b"A plain line.\n" * 2_000 + LINE.encode()))
    assert not passages(_encoded(bytes(range(256)) * 40))
    preamble = "A line before the page.\n" * 200
    assert ("stu", "pid", "gose", "inded") in passages(f"From: a\n\n{preamble}\n\n<html><p>Stu<b></b>pid goose indeed.</p></html>")


def test_deep_parts_and_short_sentences():
    text = "You filthy pig, go"
    for i in range(12):
        text = f"Content-Type: multipart/mixed; boundary=\"b{i}\"\n\n--b{i}\n{text if i else 'Content-Type: text/plain' + chr(10) * 2 + text}\n--b{i}--\n"
    assert ("you", "filthy", "pig", "go") in passages("From: a\n" + text)
    assert ("pig",) in passages("From: a\n\nPig!\n\nHm.\n")


def test_a_long_run_of_known_words_is_split():
    w = Words(["you", "are", "a", "useles", "stupid", "dimwit", "goseberyharvesterdriver"])
    assert [w.known[i] for i in w.numbers("youareauselesstupidgoseberyharvesterdriver")] == ["you", "are", "a", "useles", "stupid", "goseberyharvesterdriver"]


def test_no_document_votes_for_itself_or_its_copies(spark):
    """Two positive documents, copies of each other, with words that nobody else uses: no evidence but their own labels."""
    own = "The zorbian gadget rattles loudly at night. A purple lantern sways over the quiet meadow. Seven drums were left behind the barn. Nobody fed the heron this week."
    rows = [(i, "s", f"From: x\n\nThe pallet {'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10]} is stuck again.\nPlease send the invoice before noon.") for i in range(60)]
    rows += [(100, "s", f"From: x\n\n{own}"), (101, "s", f"From: x\n\n{own}"), (102, "s", f"From: x\n\n{own}")]
    labels = [(i, "ok") for i in range(60)] + [(100, "abusive"), (101, "abusive")]
    out = scores(spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame(labels, "doc_id long, verdict string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[100]["score"] == got[101]["score"] == 0 and got[100]["evidence"] is None
    assert got[102]["verdict"] == "abusive" and got[102]["score"] > 0


def test_copies():
    docs = [np.array(x, np.int64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 7, 8], [], [], [9], [1, 2, 3, 4, 5, 10, 11])]
    g = copies(docs)
    assert g[0] == g[1] == g[2] and len({g[0], g[3], g[6], g[7]}) == 4 and g[4] == g[5]
    assert len(set(fold_of(g, 3)[:3])) == 1


def test_calibration_gives_shares():
    rng = np.random.default_rng(4)
    votes = rng.random(40_000)
    truth = rng.random(40_000) < votes**3  # votes that are too sure
    c = Calibration.fitted(votes, truth, np.ones(40_000))
    score, low, high = c.interval(np.array([0.3, 0.5, 0.8]))
    assert np.abs(score - np.array([0.3, 0.5, 0.8]) ** 3).max() < 0.08 and (low < score).all() and (score < high).all() and (high - low).max() < 0.1
    few = Calibration.fitted(votes[:6], truth[:6], np.ones(6)).interval(np.array([0.6]))
    assert few[2][0] - few[1][0] > 0.3
    assert Calibration.fitted(np.zeros(5), np.ones(5, bool), np.ones(5)).interval(np.array([0.7]))[0][0] == pytest.approx(0.7)
    for low, high, n, mean, share in reliability(votes, truth, np.ones(40_000)):
        assert low <= mean <= high and n > 0 and abs(mean - share) < 0.12


def test_what_is_all_over_the_unlabelled_documents_is_no_example():
    spread = "this mesage is confidential"
    sample = [Labelled("abusive", [spread, "qux bar lorem"])] * 2 + [Labelled("", ["clean words here"])] * 2
    words = learn_words(sample)
    of = lambda n: fit(sample, words, np.full(len(words.known), 3), 1000, seen=Seen(pa.array([spread]), np.array([n]))).score(pa.array([spread]))[0][0]
    assert of(2) >= THRESHOLD > of(80)


def test_kept_neighbours_give_the_same_models(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows, truth = corpus(rng, 200)
    sample = [Labelled("" if truth[i] == "ok" else truth[i], [" ".join(p) for p in passages(t)], 1.0, i) for i, _, t, *_ in rows]
    words = learn_words(sample)
    x = review.Examples.of(sample, words, np.full(len(words.known), 5), 1000)
    left = np.arange(len(sample)) % 4 == 0
    plain = review.learn(x, left)
    for kept in (24, 13):  # with 13, some lists are cut short and searched again
        monkeypatch.setattr(review, "NEAR", kept)
        quick = review.learn(x, left, review.near_passages(spark, x))
        assert np.allclose(plain.positive, quick.positive) and np.allclose(plain.clean, quick.clean)


def test_scores_hold_for_all_documents_where_positive_ones_are_labelled_more_often():
    """Positive documents are 4 % of all, and half of the labelled ones."""
    rng = np.random.default_rng(8)
    draw = lambda bad: np.where(bad, rng.beta(4, 2, len(bad)), rng.beta(2, 4, len(bad)))
    labelled = rng.random(2000) < 0.5
    votes = draw(labelled)
    every = rng.random(50_000) < 0.04
    all_votes = draw(every)
    fitted = Calibration.fitted(votes, labelled, np.ones(2000))
    moved = fitted.for_all(votes, labelled, np.ones(2000), all_votes, np.ones(50_000))
    before, after = fitted.interval(all_votes)[0].mean(), moved.interval(all_votes)[0].mean()
    assert before > 0.15 and abs(after - 0.04) < 0.015
    high = moved.interval(all_votes)[0] > 0.4
    assert abs(moved.interval(all_votes)[0][high].mean() - every[high].mean()) < 0.2
    assert fitted.for_all(votes[:0], labelled[:0], np.ones(0), all_votes, np.ones(50_000)) is fitted


def test_the_middle_of_the_votes_is_calibrated_by_itself():
    """Sure at both ends, and clean in the middle: a logistic curve alone would not see it."""
    rng = np.random.default_rng(9)
    votes = np.r_[rng.uniform(0.001, 0.05, 3000), rng.uniform(0.35, 0.5, 120), rng.uniform(0.85, 0.99, 1500)]
    truth = np.r_[np.zeros(3000), rng.random(120) < 0.1, np.ones(1500)].astype(bool)
    c = Calibration.fitted(votes, truth, np.ones(len(votes)))
    score = c.interval(np.array([0.02, 0.42, 0.93]))[0]
    assert score[0] < 0.05 and abs(score[1] - 0.1) < 0.08 and score[2] > 0.95
    grid = c.interval(np.linspace(0.001, 0.999, 500))[0]
    assert (np.diff(grid) >= -1e-12).all()
