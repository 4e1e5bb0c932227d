import itertools
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import packing, segmentation, toxicity
from corvane.llm.storage import materialize
from corvane.llm.words import default_path, encoder

from .conftest import ROWS, frame

COUNTS = np.ones((toxicity.ORDER,) * 3, np.int64)


@pytest.mark.parametrize(
    ("seen", "word"),
    [("m0r0n", "moron"), ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("m o r o n", "moron"), ("i.d.i.o.t", "idiot"), ("cl0wn!!", "clown"), ("M*ron", "moron"), ("w0rthle$$", "worthless")],
)
def test_noise_is_decoded(seen, word):
    r = toxicity.Restorer(COUNTS, ["moron", "idiot", "stupid", "clown", "worthless"])
    assert word in r.restore(seen).split() and r.count_clues(seen)


@pytest.mark.parametrize(
    "seen",
    ["m0r0n-" + "a" * 36, "m0r0n-aaaa-" + "bcd-" * 12, "m0r0n2024", "2024m0r0n", "you-are-a-complete-m0r0n-and-everyone-knows-it", "m" + "o" * 60 + "ron", "mo-r0n", "m-o-r-o-n", "m_0_r_0_n", "m\to\tr\to\tn", "m/o/r/o/n", "m\no\nr\no\nn", "x" * 50_000 + "-m0r0n"],
)
def test_noise_of_any_length_is_decoded(seen):
    r = toxicity.Restorer(COUNTS, ["moron"])
    assert r.count_clues(seen) and r.count_clues(f"some words, {seen} and more")


@pytest.mark.parametrize(
    "seen",
    ["1d1075", "1d1071c", "@$$", "$#!7", "455", "b   i   t   c   h", "b i + c h", "s h 1 +", "m o r * n", "m****n", "m0r0n2024", "b!+ch", "$ # ! 7"],
)
def test_second_reading(seen):
    r = toxicity.Restorer(COUNTS, ["idiot", "moron", "shit", "ass", "bitch"])
    assert sum(r.count_clues(seen).values()) == 1 and sum(r.count_clues(f"some words {seen}, and more").values()) == 1
    assert r.marks(r.restore(seen).split()[0])


@pytest.mark.parametrize(
    "seen",
    ["1455", "4551234", "2024", "192.168.455.1", "+49-455-1234567", "a * b * c", "1   2   3   4", "#" * 5_000, "* " * 2_000, "m****", "x****y", "20 000", "4-5-6", "$$$", "# # #", "1/2/3", "$4,500.00"],
)
def test_numbers_and_marks_stay_silent(seen):
    r = toxicity.Restorer(COUNTS, ["idiot", "moron", "shit", "ass", "bitch"])
    assert not r.count_clues(seen)


def test_second_reading_by_brute_force():
    r = toxicity.Restorer(np.random.default_rng(2).integers(1, 50, (toxicity.ORDER,) * 3), ["bad", "abe", "toad"])

    def paths(seen, i, last, score, text):
        if i == len(seen):
            yield score + r._log_p(last, " "), text.strip()
            return
        for j, letter, cost in r._edges(seen[i], i, len(seen[i:]) - len(seen[i:].lstrip(seen[i]))):
            if not letter or (letter == " " and last[-1] == " "):
                yield from paths(seen, j, last, score + (-2.3 if not letter and seen[i] in "*#" else cost), text)
                continue
            if seen[i] in "*#" and letter != " ":
                fitting = r.follow.get(last, ())
                if letter not in fitting or j > i + 1:
                    continue
                cost += np.log(26 / len(fitting))
            yield from paths(seen, j, last[1:] + letter, score + cost + r._log_p(last, letter), text + letter)

    for seen in ("b#d", "8@d", "t**d", "7.0.#.d", "#b3", "$$8"):
        best, word = r._likeliest(seen, known=True)
        assert (pytest.approx(best), word) == max(paths(seen, 0, "   ", 0.0, ""))


def test_long_and_short_spaced_words():
    r = toxicity.Restorer(COUNTS, ["moron", "ass"])
    run = "q w z k p v " * 17 + "m o r o n"  # 213 characters
    assert r.restore(run).replace(" ", "").endswith("moron") and len(r.restore(run).replace(" ", "")) == 6 * 17 + 5  # nothing is read twice
    assert r.count_clues("a s s") and not r.count_clues("a and s")
    assert len(r.decode("ab-" * 30_000)) <= 90_000


def test_plain_text_stays():
    r = toxicity.Restorer(COUNTS, ["moron"])
    assert r.restore("The cook took a good book.\nVersion 3.14 of 2024") == "the cook took a good book version 3.14 of 2024".replace(" 3.14 of 2024", " of")
    assert not r.count_clues("A morose morning; the maroon room")


def test_tokens_that_can_show_no_clue_are_not_decoded(monkeypatch):
    r, decoded = toxicity.Restorer(COUNTS, ["moron", "idiot", "illegal"]), []
    monkeypatch.setattr(r, "_likeliest", lambda seen, known=False: decoded.append(seen) or (0.0, ""))
    assert not r.count_clues("A little letter from the committee, l'eau, c4lled 7-8 or 3.14; b i t t e r") and not r.seen and not decoded
    r.count_clues("letter m00ron committee")
    assert [*r.seen] == ["m00ron"] and {*decoded} == {"m00ron"}


def test_places_miss_no_clue():
    rnd, clues = random.Random(3), ["ass", "bigot", "dis", "idiot", "ill", "lil", "moron", "shit", "élan"]
    looks = {letter: [c for c, meant in toxicity.LOOKALIKES.items() if letter in meant] for letter in toxicity.LETTERS}
    r, n = toxicity.Restorer(np.random.default_rng(5).integers(0, 50, (toxicity.ORDER,) * 3), clues), 0
    for _ in range(400):
        tokens = []
        for word in rnd.choices([*clues, "letter", "rose", "42"], k=3):
            symbols = [rnd.choice([c, c, c, *looks.get(c, [c])[:3]]) * rnd.choice([1, 1, 1, 1, 2, 3]) for c in word]
            tokens.append(rnd.choice(["", "", "!", "4", "é", "x", "$$$", "2024"]) + rnd.choice(["", "", "", " ", "   ", "-", ".", "'", "\xa0"]).join(symbols) + rnd.choice(["", "", "s", ".", "!!", "99"]))
        text = rnd.choice([" ", "\n", ", ", "-"]).join(tokens)
        whole = sum(([*r.marks(word)] * k for word, k in r.words(text).items()), [])
        assert sorted(r.count_clues(text).elements()) == sorted(whole), text
        n += len(whole)
    assert n > 100


@pytest.mark.parametrize("seen", ["1", "1 ", "l.", "t7o0", "11111! ", "a5 "])
def test_places_cost_bounded_work(seen):
    found = toxicity.places(["lilo", "toot", "ass", "illegal"])
    began = time.thread_time()
    sum(1 for _ in found.finditer(seen * 100_000))
    assert time.thread_time() - began < 20  # 0.3 s at most as measured; a search that goes back does not end


def test_viterbi_by_brute_force():
    r = toxicity.Restorer(np.random.default_rng(1).integers(1, 50, (toxicity.ORDER,) * 3), ["bad", "ab"])

    def paths(seen, i, last, score, text):
        if i == len(seen):
            yield score + r._log_p(last, " "), text.strip()
            return
        for j, letter, cost in r._edges(seen[i], i, len(seen[i:]) - len(seen[i:].lstrip(seen[i]))):
            if not letter or (letter == " " and last[-1] == " "):
                yield from paths(seen, j, last, score + cost, text)
            else:
                yield from paths(seen, j, last[1:] + letter, score + cost + r._log_p(last, letter), text + letter)

    for seen in ("b4d", "a8", "baad", "b.a.d", "6a0", "$$"):
        assert r.decode(seen) == max(paths(seen, 0, "   ", 0.0, ""))[1]


def test_held_out_accuracy_and_odd_rows(spark, odd, empty, no_labels):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    rows = []
    for i in range(900):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["gruk", "zarvo"]) if i % 2 else rng.choice(["Gruk,", "z4rvo"])
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum((r.predicted == 1) == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    scored = toxicity.score(odd, no_labels).collect()
    assert len(scored) == len(ROWS) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, no_labels).count() == 0


def test_every_sure_clue_is_learnt(spark):
    starts = ["".join(s) for s in itertools.product("bdgkmprtvz", "aeiou", "bdgkmprtvz")][:400]
    rows = [(f"{s}ukolimarento tree house", 1) for s in starts for _ in range(12)] + [("tree house", 0)] * 6000
    prefixes, clues, weights = toxicity.learn_clues(spark.createDataFrame(rows, "text string, toxic int"), COUNTS)
    assert {p[:3] for p in prefixes} == set(starts) and len(clues) == len(weights) - 1 == 400


def test_trigram_counts(spark):
    got = toxicity.count_characters(frame(spark, [(1, "ab"), (2, None), (3, "Zé")]))
    want = np.zeros_like(got)
    codes = toxicity.CLASSES[np.frombuffer("\n\nab\n\n\n\nZé\n\n".encode(), np.uint8)]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        want[a, b, c] += 1
    want[0, 0, 0] = got[0, 0, 0]  # how texts are joined is no matter
    assert (got == want).all()


def test_word_ids_equal_the_library():
    enc, whole = encoder(default_path("word_bpe_49k.json")), Tokenizer.from_file(default_path("word_bpe_49k.json"))
    random.seed(1)
    letters = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 9, 10, 13]] + ["'s", "'ll", " "] * 20
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["İstanbul Σας", "a<|endoftext|>b", "\x1cx\x85y z", "", "  ", "日本語 ﬁ", "don't we'll I'M"]
    assert [t for t in texts if np.frombuffer(enc.ids(t), "<u4").tolist() != whole.encode(t, add_special_tokens=False).ids] == []


def check_packing(pieces, packed, tokens, documents=10**9, attention=10**18):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, pieces)) == sorted(map(key, packed))
    for _, rows in itertools.groupby(sorted(packed, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        rows = list(rows)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(rows) <= documents and sum(r.length**2 for r in rows) <= attention


def test_packing_odd_rows(odd, empty):
    pieces = materialize(packing.cut_documents(odd, 2048), "pieces")
    packed = packing.pack(pieces).collect()
    check_packing(pieces.collect(), packed, 2048)
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packed}) == len(packed)
    ids = Tokenizer.from_file(default_path("word_bpe_49k.json")).encode(ROWS[4][1], add_special_tokens=False).ids + [0]
    long = sorted((r for r in packed if r.doc_id == 2 and r.ids_crc32 and r.length), key=lambda r: r.start)
    assert {zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes()) for i in range(0, len(ids), 2048)} <= {r.ids_crc32 for r in long}
    assert packing.pack_documents(empty).count() == 0


def brute_best_fit(lengths, cap):
    """Open every sequence for ever and look at all of them for every piece."""
    open_ones, sequence, offset = [], {}, {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, lengths[i] ** 2)
        full, options = (cap.tokens, cap.documents, cap.attention), []
        for name, room in enumerate(open_ones):
            if all(r >= d for r, d in zip(room, need)):
                norm = sum(w * ((r - d) / f) ** 2 for w, r, d, f in zip(cap.weights, room, need, full))
                dot = sum(w * d / f * r / f for w, r, d, f in zip(cap.weights, room, need, full))
                options.append(((round(norm, 12),) if cap.rule == "norm" else (room[0], -round(dot, 12)), name))
        if options:
            name = min(options)[1]
        else:
            name = len(open_ones)
            open_ones.append(list(full))
        sequence[i], offset[i] = name, cap.tokens - open_ones[name][0]
        open_ones[name] = [r - d for r, d in zip(open_ones[name], need)]
    return [sequence[i] for i in range(len(lengths))], [offset[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_by_brute_force(rule):
    rng = np.random.default_rng(7)
    for cap in (packing.Capacity(50, 50, 2500, rule=rule), packing.Capacity(50, 3, 2500, rule=rule), packing.Capacity(50, 6, 2500, weights=(0.5, 1.0, 2.0), rule=rule)):
        lengths = rng.integers(1, 51, 150)
        sequence, offset = packing.best_fit(lengths, cap)
        assert (sequence.tolist(), offset.tolist()) == brute_best_fit(lengths.tolist(), cap)


def test_packing_does_not_depend_on_where_rows_come_from(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 100)
    rng = random.Random(5)
    rows = [(i if i % 9 else None, rng.randrange(3), 0, rng.randint(1, 2048), rng.randrange(2**32)) for i in range(1500)] + [(7, 0, 0, 1, 9)] * 600
    rows.append((2**60 + 1, 0, 0, 5, 5))
    results = []
    for parts in (1, 7):
        rng.shuffle(rows)
        packed = packing.pack(spark.createDataFrame(rows, packing.PIECES_SCHEMA).repartition(parts)).collect()
        results.append(sorted(map(str, packed)))
        check_packing([packing_row for packing_row in packed], packed, 2048)
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert len({r.sequence_id >> 40 for r in packed}) > 5 and any(r.doc_id == 2**60 + 1 for r in packed)
    least = sum(r[3] for r in rows) / 2048
    assert len({r.sequence_id for r in packed}) <= 1.06 * least + 11  # runs of 100 only; a task leaves one or two sequences open


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    lengths = np.random.default_rng(2).integers(1, 100, 3000)
    for cap in (packing.Capacity(100, 1000, 10**6, rule=rule), packing.Capacity(100, 2, 10**6, rule=rule), packing.Capacity(100, 1000, 10_000, rule=rule)):
        sequence, offset = packing.best_fit(lengths, cap)
        for total, limit in ((np.bincount(sequence, lengths), cap.tokens), (np.bincount(sequence), cap.documents), (np.bincount(sequence, lengths.astype(float) ** 2), cap.attention)):
            assert total.max() <= limit
        order = np.lexsort((offset, sequence))
        assert all(offset[b] == (offset[a] + lengths[a] if sequence[a] == sequence[b] else 0) for a, b in itertools.pairwise(order))
    least = lengths.sum() / 100
    assert packing.best_fit(lengths, packing.Capacity(100, 1000, 10**6, rule=rule))[0].max() + 1 <= 1.03 * least + 1
    with pytest.raises(ValueError):
        packing.Capacity(attention=5)


V = segmentation.Vocabulary(default_path("piece_bpe_32k.model"), 4)
ORDER = lambda path: (-path[0], len(path[1]), path[1][::-1])


def model_edges(text):
    """Every edge of a whole text's lattice, from the model file alone."""
    model = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    kinds = {i: model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    by_piece = {p: i for i, p in kinds.items()}
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
    marked = ("\u2581" + text.replace(" ", "\u2581")) if text else ""
    for i in range(len(marked)):
        known = False
        for j in range(i + 1, min(len(marked), i + 48) + 1):
            if marked[i:j] in by_piece:
                known = known or j == i + 1
                yield i, j, model.get_score(by_piece[marked[i:j]]), (by_piece[marked[i:j]],)
        if not known:
            yield i, i + 1, V.unknown, tuple(byte[b] for b in marked[i].encode())


def every_path(text):
    """All segmentations, in order."""
    edges, found, size = list(model_edges(text)), [], len(text) + 1 if text else 0

    def go(at, score, ids):
        if at == size:
            found.append((score, ids))
        for i, j, own, piece in edges:
            if i == at:
                go(j, score + own, ids + piece)

    go(0, 0.0, ())
    return sorted(found, key=ORDER)


def n_best_table(text, n=4):
    """The n best by a plain table of the n best of every prefix."""
    size = len(text) + 1 if text else 0
    held = [[(0.0, ())]] + [[] for _ in range(size)]
    for i, j, own, piece in model_edges(text):
        held[j] = sorted(held[j] + [(score + own, ids + piece) for score, ids in held[i]], key=ORDER)[:n]
    return held[size]


SHORT = ["", " ", "  ", "the", "thorreou.", "a", "a a a", "   in", "\n日x", "a\nb", "réeux,", "aaaaaaaa", "é", "▁x ▁", "the the the"]
TEXTS = SHORT + ["  x  y ", "né\nà ß", "hello world of tokens tokens tokens", "日本 語 🙂🙂", "a " * 40, "x" * 90, "ab" * 60 + " tail, " + "The cat sat. " * 30, "z" * 70 + "\n" + "q9-" * 40]


@pytest.mark.parametrize("text", SHORT)
def test_n_best_by_brute_force(text):
    want = every_path(text)[:4]
    assert V.segment(text) == want == n_best_table(text)


def test_random_texts_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("aabe  the\né日▁") for _ in range(rng.randint(0, 8)))
        assert V.segment(text) == every_path(text)[:4]


def test_whole_texts_in_the_query(spark):
    """Scores, pieces, ids and decoded texts of all n segmentations, against the table."""
    got = {r.doc_id: r for r in segmentation.best_segmentations(frame(spark, list(enumerate(TEXTS)))).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want, r = n_best_table(text), got[i]
        assert list(r.scores) == [s for s, _ in want] and list(r.n_pieces) == [len(ids) for _, ids in want]
        assert list(r.ids_crc32) == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in want]
        assert set(r.decoded_crc32) == {zlib.crc32(text.replace("▁", " ").encode())}
        assert all(V.decode(ids) == text.replace("▁", " ") for _, ids in V.segment(text))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_other_numbers_of_segmentations(n):
    v = segmentation.Vocabulary(default_path("piece_bpe_32k.model"), n)
    for text in ("the the the the the the the the the", "a b\nc", "hello world", "aaaaaa aaaaaa"):
        assert v.segment(text) == n_best_table(text, n)


def test_forgetting_units_changes_nothing():
    small = segmentation.Vocabulary(default_path("piece_bpe_32k.model"), 4)
    small.CACHE = 3
    assert [small.summaries([t]) for t in TEXTS] == [[row] for row in V.summaries(TEXTS)]


def test_segmentation_odd_rows(odd, empty):
    got = segmentation.best_segmentations(odd).collect()
    assert len(got) == len(ROWS) and all(list(r.scores) == sorted(r.scores, reverse=True) for r in got)
    assert [list(r.scores) for r in got if r.n_pieces == [0]] == [[0.0]] * 3
    assert all(len(r.scores) == len(r.n_pieces) == len(r.ids_crc32) == len(r.decoded_crc32) for r in got)
    assert segmentation.best_segmentations(empty).count() == 0
    small = segmentation.round_trip(odd.where("doc_id IN (3, 5, 7)"))
    texts = {d: t for d, t in ROWS if d in (3, 5, 7)}
    assert all(t == texts[r.doc_id] for r in small.collect() for t in r.texts)
