"""The text operators: edge cases and brute force on small fixtures, SQL where there is some."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from craterloom.llm import bpe, chat, components, exact_dedup, langid, licenses, near_dedup, packing, queries, shingles, suffix_array, topk, wavelet
from craterloom.llm.chunks import ChunkCache, library_cache, tokenizer_path
from craterloom.llm.core import ARROW_BYTES, text_bytes
from craterloom.llm.shingles import MinHash

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, part string, k1 string, uid string, score string, kept string, root string"


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, *["x"] * 8) for r in rows], SCHEMA)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = words(30_000, 1)
ROWS = [(1, None), (2, ""), (3, None), (None, "alone"), (None, "alone"), (5, "Twin text here"), (6, "Twin text here"), (6, "Twin text here"), (7, "twin text here"), (8, " \t\n"), (9, LONG), (10, LONG + " tail"), (11, "é" * 300), (12, "a"), (13, "1 2 3 !!")]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# --- op1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, data, same):
    same(queries.QUERIES[name](spark, data), queries.ORACLES[name])


def preferences(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("pair_id", "block", "said", "end", "part")})
    return df, chat.format_preferences(df, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 0, **kw).collect()


def brute_preferences(rows):
    """For each pair: prompt, chosen and rejected text, None where a side has no turn at all there."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            said.setdefault(conv // 2, ({}, {}))[conv % 2].setdefault(turn, []).append((role or "user", text or ""))
    show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) or None
    out = {}
    for pair, sides in said.items():
        c, r = ({t: min(x) for t, x in side.items()} for side in sides)
        n, every = 0, sorted(set(c) | set(r))
        while n < len(every) and c.get(every[n]) == r.get(every[n]):
            n += 1
        out[pair] = (show(c[t] for t in every[:n]), show(c[t] for t in every[n:] if t in c), show(r[t] for t in every[n:] if t in r))
    return out


def joined(got):
    """The parts of each pair, put together from their rows."""
    out = {}
    for pair in {r.pair_id for r in got}:
        mine = sorted((r for r in got if r.pair_id == pair), key=lambda r: r.seq)
        whole = lambda name, part: "".join(getattr(r, name) or "" for r in mine if r.part == part) or None  # noqa: B023, E731
        out[pair] = (whole("prompt", "prompt"), whole("chosen", "completion"), whole("rejected", "completion"))
    return out


def test_preferences_edge_cases(spark):
    rows = [
        (0, 0, "user", "hi"), (1, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 1, "assistant", "bad"), (1, 2, None, None), (0, 1, "assistant", "good"), (0, 1, "assistant", "zzz"),
        (2, 0, "user", "only"), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "lost"), (6, None, "user", "lost"),
        *((k, t, "user", "t" if k == 8 or t < 290 else "u") for k in (8, 9) for t in range(300)),
        *((k, t, "user", "t" if t < 300 else str(k)) for k in (10, 11) for t in range(304)),
        *((2**60 + k, 0, "user", "ab"[k % 2]) for k in range(3, 8)), (-3, 0, "user", "minus"), (-4, 0, "user", "minus"), (20, -5, "user", "early"), (21, 10**12, "user", "late"),
    ]
    df, got = preferences(spark, rows)
    assert joined(got) == brute_preferences(rows)
    one = {r.part: r for r in got if r.pair_id == 0}
    assert one["prompt"].prompt == "<|im_start|>user\nhi<|im_end|>\n" and one["completion"].chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert one["completion"].rejected_mask == "0:22,1:14,0:17,0:11" and one["completion"].chosen_mask == "0:22,1:15"
    assert {r.part for r in got if r.pair_id == 2} == {"prompt"} and {(r.part, r.side) for r in got if r.pair_id == 1} == {("completion", "chosen")}
    # a prompt never shares a row with a completion, however long the conversations
    assert all((r.prompt is None) == (r.part == "completion") and (r.part == "completion" or (r.chosen, r.rejected) == (None, None)) for r in got)
    long = sorted((r.part, r.seq, r.turns) for r in got if r.pair_id == 5)
    assert long == [("completion", 0, 4), ("prompt", 0, 256), ("prompt", 1, 44)] and {r.prompt_end for r in got if r.pair_id == 5} == {300}
    assert {(r.pair_id, r.chosen, r.rejected) for r in got if r.pair_id == 2**59 + 2} == {(2**59 + 2, "<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\nb<|im_end|>\n")}
    assert not any(r.pair_id is None or r.pair_id == 3 for r in got)
    assert chat.format_preferences(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_preferences_in_small_blocks(spark):
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab") if t > c % 5 else "a") for c in range(40) for t in range(rng.randint(0, 12))]
    _, got = preferences(spark, rows, block_turns=3)
    assert joined(got) == brute_preferences(rows)


def test_preferences_stay_with_dataframes():
    assert not re.search(r"pandas|mapIn|applyIn|rdd|udf", "".join(open(chat.__file__).readlines()[30:]))


# --- op2


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = queries.QUERIES["op2_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_id_edge_cases(spark, data):
    model = langid.train(spark.read.parquet(f"{data}/documents.parquet"), 50, 32)
    got = langid.identify(documents(spark, ROWS), model).select("doc_id", "text", "lang_pred", "score", "id").collect()
    assert len(got) == len(ROWS) and all(r.id == "x" for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    empty = langid.train(documents(spark, [(1, "a", None), (2, None), (None, "x")]))
    assert {r.lang_pred for r in langid.identify(documents(spark, ROWS), empty).collect()} == {"und"}
    assert langid.identify(documents(spark, []), model).count() == 0


def test_no_language_is_dropped(spark):
    rows = [(i, f"text of {i} {chr(97 + i % 26) * 3}", f"l{i % 6}") for i in range(60)]
    assert len(langid.train(documents(spark, rows), languages=6).languages) == 6
    with pytest.raises(ValueError, match="more than 5 values"):
        langid.train(documents(spark, rows), languages=5)
    many = spark.range(2004).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 501) AS lang")
    with pytest.raises(ValueError, match="more than 500 values"):
        langid.train(many)


def brute_language(texts, langs, queries, landmarks, ridge):
    """Presence kernels from sets of strings, Nystroem ridge regression as in the books."""
    fold = lambda t: "".join(c if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "." for c in t.lower())
    sets = lambda ts: [{fold(t)[i:i + n] for n in (1, 2, 3) for i in range(len(fold(t)) - n + 1)} for t in ts]
    kernel = lambda x, y: np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in y] for a in x])
    names, own = sorted(set(langs)), sets(texts)
    picked = [own[i] for n in names for i in [k for k, x in enumerate(langs) if x == n][:landmarks // len(names)]]
    kmm, knm = kernel(picked, picked), kernel(own, picked)
    w = np.diag([1 / langs.count(x) for x in langs])
    y = np.array([[float(x == n) for n in names] for x in langs])
    # of all minimisers the one in the span of the landmarks: (K_mn W K_nm + lambda K_mm) a = K_mn W y
    a = np.linalg.lstsq(knm.T @ w @ knm + ridge * w.trace() / len(texts) * kmm, knm.T @ w @ y, rcond=None)[0]
    score = kernel(sets(queries), picked) @ a
    return [names[i] for i in score.argmax(1)], np.clip(score.max(1), 0, 1)


SCRIPTS = {"en": "abcdefghij", "ru": "абвгдежзик", "ka": "აბგდევზთიკ", "hy": "աբգդեզէըթժ", "th": "กขคงจฉชซฌญ", "zh": "".join(map(chr, range(0x4E00, 0x4F80)))}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SCRIPTS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_scores_against_direct_kernels():
    rng = random.Random(5)
    langs = [x for x in ("en", "ru", "zh") for _ in range(8)] + ["en"] * 5
    texts = [prose(x, 12, rng) + rng.choice(["", " 12!", "\tA"]) for x in langs]
    queries_ = [prose(x, 6, rng) for x in ("en", "ru", "zh", "th", "en")] + [texts[0] + texts[9], "é"]
    for small in (langid.Model.SMALL, 1, 10_000):
        langid.Model.SMALL, before = small, langid.Model.SMALL
        try:
            model = langid.fit(texts, langs, landmarks=12, ridge=0.1)
            lang, score = model.predict(queries_)
        finally:
            langid.Model.SMALL = before
        want, value = brute_language(texts, langs, queries_, 12, 0.1)
        assert np.abs(score - value).max() < 1e-6 and [x for x, v in zip(lang, value) if v > 0.05] == [x for x, v in zip(want, value) if v > 0.05]


def test_every_script_is_told_apart(spark):
    rng = random.Random(6)
    rows = [(i, prose(x, 40, rng), x) for i, x in enumerate(list(SCRIPTS) * 12)]
    model = langid.train(documents(spark, rows), per_language=8, landmarks=24)
    got = langid.identify(documents(spark, [(1000 + i, prose(x, 30, rng), x) for i, x in enumerate(list(SCRIPTS) * 10)]), model).collect()
    assert [(r.lang, r.lang_pred) for r in got if r.lang != r.lang_pred] == []


def test_sample_is_bounded_and_reaches_every_passage(spark):
    text = "".join(chr(97 + i) * 50 for i in range(20))
    docs = documents(spark, [(i, text, "en") for i in range(300)] + [(500 + i, "short one", "de") for i in range(3)])
    texts, langs = langid.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", 100, passage=50)
    assert langs.count("en") == 100 and langs.count("de") == 3 and all(len(t) <= 50 for t in texts)
    assert len({t[0] for t, x in zip(texts, langs) if x == "en"}) > 15


# --- op3


def brute_repeats(texts, w=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + w] for b in raw for i in range(len(b) - w + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - w + 1):
            if seen[b[i:i + w]] > 1:
                gone[i] += 1
                gone[i + w] -= 1
        g = np.cumsum(gone[:-1]) > 0
        out.append((len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return out


def check_repeats(spark, rows, **kw):
    df = documents(spark, rows).withColumns({"n": F.monotonically_increasing_id(), "a.b": F.lit("x"), "others": F.lit("x"), "n_spans": F.lit("x")})
    got = suffix_array.remove_repeats(df, **kw).orderBy("n").collect()
    want = brute_repeats([r.text for r in df.orderBy("n").collect()], kw.get("width", 200))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want and all(r["a.b"] == r.k1 == r.others == "x" for r in got)


SHORT = [r for r in ROWS if r[1] is not LONG and not (r[1] or "").startswith(LONG)]


def repeat_rows():
    part, other = words(60, 3), words(60, 4)
    return SHORT + [(20, part), (21, "x" + part[5:-5] + "y"), (22, other + part[10:260] + other[3:]), (23, "ab" * 400), (24, "a" * 199), (25, "é" * 150), (26, part[:199]), (27, "\x00" * 250 + part), (28, "\x7f" * 200), (29, "\x7f" * 200)]


def test_repeats_edge_cases(spark):
    check_repeats(spark, repeat_rows())
    check_repeats(spark, [(1, LONG[:5000]), (2, LONG[2000:9000]), (3, LONG[4000:4700] + LONG[100:500])])
    assert suffix_array.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_of_one_very_long_text(spark):
    long = LONG[:20_000] + LONG[500:900] + LONG[20_000:26_000]
    data = np.frombuffer(long.encode(), np.uint8)
    parts = list(suffix_array._parts(data, np.array([0, len(data)]), 200, 3000))
    covered = sorted((lo, hi) for _, _, lo, hi, _ in parts)
    assert len(parts) > 4 and all(b[0] + 199 <= a[1] for a, b in zip(covered, covered[1:])) and covered[-1][1] == len(data)
    check_repeats(spark, [(1, long), (2, LONG[19_900:20_300]), (3, "a" * 15_000)], slice_bytes=3000)


def test_anchors_with_many_contexts(spark):
    # windows of a very common passage are dealt singly
    rows = [(i, words(8, 100 + i) + " " + LONG[:260] + " " + words(8, 200 + i)) for i in range(12)] + [(50, words(8, 100) + " " + LONG[:230])]
    for many in (20_000, 2, 1):
        check_repeats(spark, rows, many=many)


@pytest.mark.parametrize("which", ["content", "anchor", "both"])
@pytest.mark.parametrize("many", [5000, 2])
def test_hashes_decide_nothing(spark, which, many):
    class Constant(suffix_array.Rolling):
        def ranges(self, prefix, start, end):
            return np.full(len(start), 7, np.uint64)

        def fixed(self, prefix, width):
            return np.full(len(prefix) - width, 7, np.uint64)

    hashes = {"content": {"content": Constant(1)}, "anchor": {"anchor": Constant(1)}, "both": {"content": Constant(1), "anchor": Constant(1)}}[which]
    check_repeats(spark, [r for r in repeat_rows() if r[0] != 27] + [(40, LONG[:700]), (41, LONG[300:900])], many=many, **hashes)


def test_sorted_spans_folds_by_bytes():
    rows = [(1, 10, 0, 1, False, b"abcd"), (1, 11, 5, 1, True, b"abcd"), (1, 12, 0, 2, False, b"xabcd"), (2, 13, 0, 1, False, b"abcd"), (2, 14, 3, 2, True, None)]
    got = [x for part in suffix_array.sorted_spans(iter(rows), 4, 1) for x in part]
    assert sorted(got) == [(10, 0, 4), (12, 1, 5), (14, 3, 8)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_two_stage_sort(texts, w):
    raw = [t.encode() for t in texts]
    starts = [len(b) - w + 1 for b in raw]
    seen = Counter(b[i:i + w] for b in raw for i in range(len(b) - w + 1))
    assert [h.tolist() for h in suffix_array.repeated_windows(raw, starts, w)] == [[seen[b[i:i + w]] > 1 for i in range(n)] for b, n in zip(raw, starts)]


# --- op4, op5, op7


TRICKY = st.text(st.sampled_from(list(" \n\t.,' 　́éßİ漢🙂aabcStT1٣<|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY, max_size=5))
def test_chunks_keep_ids(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    for path, cache in ((WORD, library_cache(WORD)), (BYTE, bpe._worker(BYTE).cache)):
        ids, at = cache.rows(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in LIB[path].encode_batch(texts, add_special_tokens=False)]


LIB = {p: library(p) for p in (BYTE, WORD)}


def test_words_with_marks_are_encoded_together(monkeypatch):
    """Words, with marks behind them or not, never go to the library one by one, and get its ids."""
    letters, marks = [*"abzAZsStd", *map(chr, (0xC0, 0xDF, 0xE9, 0xFF))], [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|"]
    rng = random.Random(4)
    texts = [" " * rng.randint(0, 1) + "".join(rng.choices(letters, k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.choice((0, 1, 3)))) for _ in range(2000)]
    encode = library_cache(WORD).encode
    monkeypatch.setattr("craterloom.llm.chunks.plain", None)
    which, flat, lengths = encode(texts)
    got = dict(zip(which, np.split(flat, np.cumsum(lengths)[:-1])))
    assert [got[i].tolist() for i in range(len(texts))] == [e.ids for e in LIB[WORD].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\x0b.,!'<|-_zAé×÷ßÀÞÿà\xa0漢7")), min_size=1, max_size=6), min_size=1, max_size=40))
def test_chunks_of_any_shape_keep_ids(texts):
    which, flat, lengths = library_cache(WORD).encode.of_bytes([t.encode() for t in texts])
    got = dict(zip(which, np.split(flat, np.cumsum(lengths)[:-1])))
    assert [got[i].tolist() for i in range(len(texts))] == [e.ids for e in LIB[WORD].encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_keeps_what_comes_again():
    """Chunks that stood in two calls are not encoded anew after the cache was full; rows keep their ids."""
    asked = []

    def encode(chunks):
        asked.append(set(chunks))
        return range(len(chunks)), np.array([int(c) + k for c in chunks for k in range(int(c) % 3)], np.uint32), np.array([int(c) % 3 for c in chunks])

    cache = ChunkCache(encode)
    cache.limit = 80
    for call in range(30):
        numbers = [*range(10), *range(100 + 12 * call, 112 + 12 * call)]
        data, offsets = text_bytes(pa.array(["".join(f" {n}" for n in numbers), "", " 7 5"]))
        ids, at = cache.rows(data, offsets)
        want = [[n + k for n in row for k in range(n % 3)] for row in (numbers, [], [7, 5])]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want and len(cache.at) <= 80
    assert sum(" 5" in chunks for chunks in asked) == 1 and sum(" 112" in chunks for chunks in asked) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "er", "==", " ", "é", "0", "\n", "ing", "aaaa", "-"]), max_size=200), st.integers(1, 50))
def test_stream_equals_whole(parts, block):
    b = bpe._worker(BYTE).bpe
    raw = "".join(parts).encode()
    assert list(b.stream(raw[i:i + block] for i in range(0, len(raw), block))) == b.merged(raw)


PIECES = st.lists(st.sampled_from(["the", "er", " ", "  ", "\n", "\t ", "é", "漢", "0", "12", "'", "'l", "l", "'re", "!", "!'", "<|endof", "text|>", "<|endoftext|>", "<", "a" * 30, " " * 30, "=" * 30, "7" * 30, "\x1c", "\u00a0"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 40), st.sampled_from([8, 20, 2048]))
def test_encoder_in_blocks(parts, block, hold):
    text, b = "".join(parts), bpe._worker(BYTE).bpe
    before, bpe.HOLD = bpe.HOLD, hold
    try:
        encoder, got = bpe.Encoder(b), []
        for i in range(0, len(text), block):
            got += encoder.feed(text[i:i + block])
            assert len(encoder.rest) <= hold + block + 2 and len(encoder.machine.buffer) <= bpe.BLOCK + b.lookahead + 200
        got += encoder.close()
    finally:
        bpe.HOLD = before
    assert got == LIB[BYTE].encode(text, add_special_tokens=False).ids


def test_encoder_keeps_constant_memory():
    b = bpe._worker(BYTE).bpe
    for unit in ("ab", " ", "=-", "9", "word <|endoftext|> "):
        encoder, most, n = bpe.Encoder(b), 0, 0
        for _ in range(60):
            n += len(encoder.feed(unit * 2000))
            most = max(most, len(encoder.rest) + len(encoder.mark) + len(encoder.machine.buffer))
        n += len(encoder.close())
        assert most < 3 * bpe.HOLD + bpe.BLOCK + b.lookahead and n > 0


def test_long_rows_are_streamed(spark):
    rows = [(1, LONG[:9000] + "=" * 4000 + " don't <|endoftext|> " + "é漢" * 3000), (2, "short"), (3, " " * 5000 + "x")]
    for r in bpe.round_trip(documents(spark, rows), BYTE, keep=True, slice_bytes=1000).collect():
        text = dict(rows)[r.doc_id]
        ids = LIB[BYTE].encode(text, add_special_tokens=False).ids
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids)) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoder(ids):
    assert bpe._worker(BYTE).bpe.decode(ids) == LIB[BYTE].decode(ids, skip_special_tokens=False)


def test_bpe_edge_cases(spark):
    rows = [*ROWS, (14, "say <|endoftext|> twice <|endoftext|>"), (15, "=" * 5000)]
    got = {(r.doc_id, r.decoded): (r.n_tokens, r.ids) for r in bpe.round_trip(documents(spark, rows), BYTE, keep=True).collect()}
    for doc, text, *_ in rows:
        ids = LIB[BYTE].encode(text or "", add_special_tokens=False).ids
        assert got[doc, text or ""] == (len(ids), ids)
    assert bpe.round_trip(documents(spark, []), BYTE).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_shards(spark):
    rows = [*ROWS, *((700, f"copy {i % 3}") for i in range(40))]
    df = documents(spark, rows)
    shards = wavelet.write_shards(df, WORD, 2, shard_tokens=500)
    got = wavelet.read_documents(shards).orderBy("start").collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = LIB[WORD].encode(text or "", add_special_tokens=False).ids + [2]
        want[doc, len(ids), crc(ids), ids[0], ids.count(ids[0]), len(ids) - 1 - ids[::-1].index(ids[0])] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.first_id, r.n_first, r.last_first) for r in got) == want and shards.count() > 3
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert len({r[0] for r in shards.select("_metadata.file_path").collect()}) == shards.count()  # a file each
    token = LIB[WORD].encode("copy").ids[0]
    places = Counter((r.doc_id, r.place) for r in wavelet.find_token(shards, token).collect())
    assert places == Counter((doc, k) for doc, text, *_ in rows for k, i in enumerate(LIB[WORD].encode(text or "", add_special_tokens=False).ids) if i == token) and places[700, 0] == 40
    empty = wavelet.write_shards(documents(spark, []), WORD, 2)
    assert wavelet.read_documents(empty).count() == 0 and wavelet.find_token(empty, 2).count() == 0


def test_planes_are_compressed_and_unpacked_where_needed():
    a = np.random.default_rng(4).zipf(1.3, 600_000) % 40_000
    raw = wavelet.WaveletMatrix.build(a).to_bytes()
    assert len(raw) < 0.85 * (a.max().item().bit_length() / 8 * len(a))
    w = wavelet.WaveletMatrix.from_bytes(raw)
    at = np.array([5, 599_999, 77])
    assert w.access(at).tolist() == a[at].tolist() and any(p.missing.any() for p in w.planes)
    values = a[[3, 50_000, 7]]
    assert w.counts(values, [0, 10, 99], [600_000, 400_000, 99]).tolist() == [(a == values[0]).sum(), (a[10:400_000] == values[1]).sum(), 0]
    assert w.selects(values, [0, 1, 10**7]).tolist() == [np.flatnonzero(a == values[0])[0], np.flatnonzero(a == values[1])[1], -1]
    assert (w.tokens() == a).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=700))
def test_wavelet_queries(values):
    a = np.array(values, np.int64)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(a).to_bytes())
    assert w.tokens().tolist() == values
    if values:
        assert w.access(np.arange(len(a))).tolist() == values
    for v in range(11):
        at = np.flatnonzero(a == v)
        assert w.count(v) == len(at) and w.count(v, len(a) // 3, len(a) // 2) == (a[len(a) // 3:len(a) // 2] == v).sum()
        assert [w.select(v, k) for k in range(0, len(at), 9)] == at[::9].tolist()
        with pytest.raises(IndexError):
            w.select(v, len(at))


def test_packing(spark):
    df = documents(spark, [*ROWS, *((100 + i, words(30 + 7 * i, i)) for i in range(60))])
    got = packing.pack_documents(df, WORD, 1, length=512, keep_ids=True).toPandas()
    want = Counter()
    for r in df.collect():
        ids = LIB[WORD].encode(r.text or "", add_special_tokens=False).ids + [1]
        want.update((r.doc_id, k // 512, k, len(ids[k:k + 512]), crc(ids[k:k + 512])) for k in range(0, len(ids), 512))
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 2
    assert packing.pack_documents(documents(spark, []), WORD, 1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold(lengths):
    bins, at = packing.best_two_fit(np.array(lengths, np.int64), 64)
    for b in set(bins.tolist()):
        inside = sorted((o, n) for x, o, n in zip(bins, at, lengths) if x == b)
        assert sum(n for _, n in inside) <= 64 and [o for o, _ in inside] == np.cumsum([0, *(n for _, n in inside)])[:-1].tolist()


def naive_two_fit(lengths, capacity):
    """The bins, as lists of lengths, from the rule: largest first, then two for the smallest."""
    left, bins = sorted(lengths), []
    while left:
        inside, gap = [], capacity
        while fit := [n for n in left if n <= gap]:
            inside.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        if gap and left and len(inside) > 1:
            room = gap + inside[-1]
            pairs = [(a + b, a, b) for i, b in enumerate(left) for a in left[i + 1:] if inside[-1] < a + b <= room]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a), left.remove(b)
                left = sorted([*left, inside[-1]])
                inside[-1:] = [a, b]
        bins.append(inside)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([40, 64, 97]))
def test_two_fit_against_the_rule(lengths, capacity):
    bins, at = packing.best_two_fit(np.array(lengths, np.int64), capacity)
    got = [[n for _, n in sorted((o, n) for x, o, n in zip(bins, at, lengths) if x == b)] for b in range(len(set(bins.tolist())))]
    assert got == naive_two_fit(lengths, capacity)


# --- op6


def test_automaton_statistics():
    rng = random.Random(6)
    for _ in range(100):
        seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        a, text = licenses.SuffixAutomaton(seqs), [rng.randrange(5) for _ in range(25)]
        for i, (_, length) in enumerate(a.statistics(text)):
            assert length == max([0, *(k for k in range(1, i + 2) if any(q[j:j + k] == text[i + 1 - k:i + 1] for q in seqs for j in range(len(q) - k + 1)))])


def test_runs_are_placed_on_every_template():
    rng = random.Random(7)
    for _ in range(100):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(4)]
        text = [rng.randrange(4) for _ in range(25)]
        want = set()
        for t, q in enumerate(seqs):
            for i in range(len(text)):
                for j in range(len(q)):
                    k = 0
                    while i + k < len(text) and j + k < len(q) and text[i + k] == q[j + k]:
                        k += 1
                    if k >= 2 and not (i and j and text[i - 1] == q[j - 1]):
                        want.add((i + k, k, t, j + k))
        got = list(licenses.SuffixAutomaton(seqs).matches(text, 2))
        assert len(got) == len(set(got)) and set(got) == want


def test_template_that_another_one_prolongs(spark):
    texts = ['Licensed under the Apache License, Version 2.0 (the "License"). See LICENSE.', "Licensed under the Apache License, Version 2.0. The end", "Licensed under the Apache License, Version 2.0"]
    for r in licenses.scan_licenses(documents(spark, [(i, t) for i, t in enumerate(texts)])).collect():
        assert (r.labels, r.score) == ("apache-2.0", 1.0) and [(s.first_word, s.last_word) for s in r.spans] == [(0, 7)]


def test_every_copy_of_a_notice_has_a_span(spark):
    mit = "Released under the MIT License"
    texts = [f"{mit}. {mit}.", f"{mit} {'x ' * 40} {mit} {'y ' * 40}{mit}", " ".join([mit] * 3000)]
    got = {r.doc_id: [(s.first_word, s.last_word) for s in r.spans if s.coverage == 1] for r in licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert got[0] == [(0, 4), (5, 9)] and got[1] == [(0, 4), (45, 49), (90, 94)] and got[2] == [(5 * i, 5 * i + 4) for i in range(3000)]


def dearest(found, least, gap):
    """The best chain of what does not overlap those taken, again and again."""
    out = []
    while True:
        top, best = (0, 0, 0), []
        for i, (a, b, ta, tb) in enumerate(found):
            best.append((tb - ta, a, b))
            for j in range(i):
                pb, pta, ptb = found[j][1:]
                over = max(0, pb - a, ptb - ta)
                apart = all(not (best[j][1] < q and b > p) for _, p, q in out)
                if apart and pta < ta and ptb < tb and pb < b and over < tb - ta and max(a - pb, ta - ptb) <= gap and best[j][0] + tb - ta - over > best[-1][0]:
                    best[-1] = (best[j][0] + tb - ta - over, best[j][1], b)
            if best[-1][0] > top[0] or (best[-1][0] == top[0] and best[-1][1:] < top[1:]):
                top = best[-1]
        if top[0] < least:
            return out
        out.append(top)
        found = [m for m in found if m[1] <= top[1] or m[0] >= top[2]]


@pytest.mark.parametrize("size", [19, 40, 250])
def test_chains_do_not_overlap_a_better_one(size):
    rng = random.Random(8)
    for _ in range(150):
        found = set()
        for _ in range(rng.randint(1, 40)):
            n, a, t = rng.randint(3, 7), rng.randrange(150), rng.randrange(14)
            found.add((a, a + n, t, t + n))
        assert licenses.Scanner.chains(sorted(found), 6, size) == dearest(sorted(found), 6, licenses.allowed_gap(size))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text, templates, base):
    """n_words, places of the base phrases and spans, from the definitions."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: WORDS.findall(t.translate(low))
    words = split(text)
    places = sorted((i, label) for phrase, label in base for i in range(len(words)) if words[i:i + len(split(phrase))] == split(phrase))
    spans = []
    for label, template in templates:
        own, found = split(template), []
        for i in range(len(words)):
            for j in range(len(own)):
                k = 0
                while i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                    k += 1
                if k >= 3 and not (i and j and words[i - 1] == own[j - 1]):
                    found.append((i, i + k, j, j + k))
        for cover, a, b in dearest(sorted(found), 0.75 * len(own), min(12, len(own) // 20)):
            if (cover := cover / max(len(own), b - a)) >= 0.75:
                spans.append((label, a, b - 1, cover))
    kept = []
    for x in sorted(spans, key=lambda x: (-x[3], x[1], x[2], x[0])):
        if not any(y[0] != x[0] and y[3] > x[3] and y[1] <= x[2] and x[1] <= y[2] for y in kept):
            kept.append(x)
    return len(words), places, kept


def test_scan_against_definitions():
    rng = random.Random(13)
    own = [x for x in licenses.TEMPLATES if len(x[1]) < 700]
    scanner = licenses.Scanner()
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(own)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 2)] = rng.choice([[], ["lesser"], ["new", "words"], ["CC", "BY"]])
            text += w[rng.choice([0, 0, 3]):] + rng.choice([[], ["all", "rights", "reserved."], ["x"] * 3])
        texts.append(" ".join(text))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    for text, (n, places, spans) in zip(texts, scanner.scan(data, offsets)):
        want = brute_scan(text, licenses.TEMPLATES, licenses.BASE)
        assert (n, sorted(places)) == want[:2] and sorted(spans) == sorted(want[2])


def test_kindred_licences_are_told_apart(spark):
    texts = {"": "This work is licensed under terms of its own", "lgpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"}
    for label, name, short in licenses.CREATIVE:
        texts[label] = f"Copyright 2020. This work is licensed under a Creative Commons {name} 4.0 International License."
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(enumerate(texts.values())))).collect()}
    for i, label in enumerate(texts):
        assert set(got[i].labels.split(",")) - {"gpl" if label == "lgpl" else "x"} == {label}, texts[label]
    short = {label: f"Licensed under {x} 4.0" for label, _, x in licenses.CREATIVE}
    for r in licenses.scan_licenses(documents(spark, list(enumerate(short.values())))).collect():
        assert {s.label for s in r.spans} == {list(short)[r.doc_id]}


def test_licenses(spark, data):
    notice = next(t for x, t in licenses.TEMPLATES if x == "mit")
    rows = [*ROWS, (30, "See CC BY and cc-by; general PUBLIC license."), (31, "head " + notice.upper() + " tail"), (32, "All rights reserved"), (33, "all rights"), (34, notice[:60]), (35, notice.replace("modify", "adapt"))]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    n = lambda t: len(word.findall((t or "").lower()))
    one = got[30, n(rows[-6][1])]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (3, 1, 6, "cc-by,gpl", 1.0)
    assert got[31, n(rows[-5][1])].labels == "mit" and [s.first_word for s in got[31, n(rows[-5][1])].spans][0] == 1
    assert got[32, 3].labels == "reserved" and got[33, 2].labels == "" and got[34, n(rows[-2][1])].labels == ""
    assert got[35, n(rows[-1][1])].labels == "mit" and got[35, n(rows[-1][1])].score < 1
    assert got[1, 0].first_word is None and got[1, 0].score == 0 and got[9, n(LONG)].labels == ""
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# --- op8


def test_exact_groups(spark):
    for limit in (1 << 20, 300):  # the small table spills and recurses
        got = exact_dedup.exact_groups(documents(spark, ROWS * 3), limit=limit).collect()
        texts = {hashlib.sha256((r[1] or "").encode()).hexdigest(): r[1] or "" for r in ROWS}
        sizes, best = Counter((r[1] or "") for r in ROWS * 3), {}
        for d, t, *_ in ROWS:
            best[t or ""] = max((x for x in (best.get(t or ""), d) if x is not None), default=None)
        assert len(got) == 3 * len(ROWS) and Counter(r.kept for r in got)[True] == len(texts)
        for r in got:
            t = texts[r.text_sha256]
            assert (r.group_size, r.keep_id) == (sizes[t], best[t]) and (not r.kept or r.doc_id == r.keep_id)
        kept = exact_dedup.drop_exact(documents(spark, ROWS * 3), limit=limit).collect()
        assert {r.text or "": r.doc_id for r in kept} == best and len(kept) == len(best) and all(r.h == "x" for r in kept)
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_grace_compares_contents(tmp_path):
    def merge(a, b):
        a[0] += b[0]

    rng = random.Random(8)
    texts = [b"%d" % rng.randrange(200) for _ in range(2000)]
    got = {t: v[0] for t, v in exact_dedup.grace(iter([(len(t) << 60, t, [1]) for t in texts]), merge, str(tmp_path), 5000)}
    assert got == Counter(texts) and not list(tmp_path.iterdir())


# --- op9


def brute_near(rows, width, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = word.findall((t or "").translate(low))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return Counter(out)


def near_rows():
    rng, out = random.Random(9), list(ROWS)
    for g in range(6):
        base = words(60, 50 + g).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(60)] = "new" + str(rng.randrange(1000))
            out.append((1000 * g + 100 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("width, percent, block", [(3, 85, 2048), (5, 80, 2048), (3, 85, 4)])
def test_near_groups(spark, width, percent, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(documents(spark, rows), width, percent).collect())
    assert got == brute_near(rows, width, percent)


def test_near_empty_and_drop(spark):
    assert near_dedup.near_groups(documents(spark, [])).count() == 0
    rows = [r for r in near_rows() if r[0] is not None and r[0] >= 100]
    kept = near_dedup.drop_near(documents(spark, rows), 3, 85).collect()
    assert sorted(r.doc_id for r in kept) == sorted({x[2] for x in brute_near(rows, 3, 85)}) and all(r.uid == "x" for r in kept)


def test_near_batches_of_long_texts(spark, tmp_path, monkeypatch):
    """Workers get texts in batches of a few MB, however many rows those are; what the session had set holds again after."""
    tidied = near_dedup.tidy

    def noting(run):
        def noted(batches):
            for b in batches:
                (tmp_path / f"{b.num_columns}-{random.random()}").write_text(str(b.nbytes))
                yield b

        return tidied(lambda batches: run(noted(batches)))

    monkeypatch.setattr(near_dedup, "tidy", noting)
    base, held = words(4000, 77), spark.conf.get(ARROW_BYTES)
    rows = [(i, f"{base} {i} {i}") for i in range(250)]
    got = near_dedup.near_groups(documents(spark, rows).coalesce(1), 3, 85).collect()
    assert len(got) == 250 and {r.component_id for r in got} == {0}
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) > 20_000_000 and max(sizes) < near_dedup.BLOCK_BYTES * 5 // 8
    assert spark.conf.get(ARROW_BYTES).removesuffix("b") == held.removesuffix("b")


def test_words_that_fool_polynomial_hashes(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, other), (3, f"x y {thue} z"), (4, f"x y {other} z"), (5, thue.upper())]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(documents(spark, rows), 3, 85).collect())
    assert got == brute_near(rows, 3, 85) and {x[2] for x in got} == {1, 2, 3, 4}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", "cc", "\n", "é"]), max_size=9), max_size=6), st.integers(1, 5))
def test_shingles(texts, width):
    texts = [" ".join(t) for t in texts]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.replace("B", "b"))
        want.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    for got in (shingles.hashed_sets(data, offsets, width)[0], shingles.hashed_sets(data, offsets, width)[1], shingles.exact_sets(data, offsets, width)):
        assert [len(g) for g in got] == [len(x) for x in want]
        assert [[len(np.intersect1d(a, b)) for a in got] for b in got] == [[len(a & b) for a in want] for b in want]


def test_words_decide_links():
    """Signatures that all agree: every pair comes to the comparison of words."""
    rows = [r for r in near_rows() if r[0] is not None and r[0] >= 100][:30]
    texts = [t.encode() for _, t in rows]
    sizes = np.array([n for _, n, _ in sorted(brute_near(rows, 3, 85).elements())])
    links = near_dedup.Verifier(3, 85).links(list(range(30)), np.zeros((30, 128), np.uint32), sizes, texts, np.arange(30), None)
    root = list(range(30))
    for a, b in links:
        root = [root[a] if x == root[b] else x for x in root]
    assert len(set(root)) == len({c for _, _, c in brute_near(rows, 3, 85)}) < 30


def test_bayes_thresholds():
    from math import comb

    for t in (0.8, 0.85):
        for n, m in zip((32, 64, 96, 128), near_dedup.least_matches(t)):
            tail = lambda m: sum(comb(n + 1, k) * t**k * (1 - t)**(n + 1 - k) for k in range(m + 1))  # noqa: E731, B023
            assert tail(m) >= near_dedup.MISS > tail(m - 1)


def test_minhash_estimates():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 2000).astype(np.uint64)
    h = MinHash(512)
    assert abs((h.of(s[:1500]) == h.of(s[500:])).mean() - 0.5) < 0.08


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op10


def brute_top(rows, k):
    out = []
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % 20 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, k, shard_rows, first_wave", [(8192, 5, 1 << 16, 8), (2, 3, 30, 8), (4, 6, 20, 2)])
def test_top_k(spark, block, k, shard_rows, first_wave):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(1)]) for i in range(400)] + [(400, None), (None, [1.0] * 8), (420, [1.0, None]), (440, [float("nan")] * 8), (460, []), (480, [1.0, 2.0]), (481, [3.0, 1.0]), (7, [9.0] * 8), (7, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k, query_block=block, leaf=16, shard_rows=shard_rows, first_wave=first_wave).collect())
    assert got == brute_top([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # products beyond what doubles hold exactly
    big = spark.createDataFrame([(i, [float(2**22 + i) * 2**3, float(-i)], "x") for i in range(60)], "vec_id long, embedding array<double>, id string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(big, F.col("vec_id") % 20 == 0, 3, scale=64).collect())
    assert got == brute_top([(r[0], r[1]) for r in big.collect()], 3)


def test_shared_score_prunes():
    rng = np.random.default_rng(12)
    x = rng.integers(-60, 60, (4000, 8))
    shard = topk.Shard(np.arange(4000), x, 16)
    q, none = x[:5], np.full(5, -np.inf)
    found = {m: (s, v) for m, s, v in shard.search(np.arange(5), q, none, 4)}
    kth = np.array([found[i][0][-1] for i in range(5)], float)
    again = {m: (s, v) for m, s, v in shard.search(np.arange(5), q, kth, 4)}
    assert all((found[i][0] == again[i][0]).all() and (found[i][1] == again[i][1]).all() for i in range(5))
    assert not list(shard.search(np.arange(5), q, kth + 1e6, 4))


# --- the pipeline


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(150)
    odd = [(9001, None, None, None, None), (9002, "12 !!", "en", "s", 5), (9003, "", "en", "s", 0), (None, "no id at all here, twice", None, "s", None), (None, "no id at all here, twice", None, "s", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("score", "lang_pred", "n_bytes", "n_removed", "_id", "_key", "others", "kept_text", "a.b")})
    columns = docs.columns
    step = lambda name, df: spark.createDataFrame(dict(p.STAGES)[name](spark, df, data).collect(), docs.schema) if name != "pack" else dict(p.STAGES)[name](spark, df, data)
    own = lambda r: all(r[c] == f"{c} of {'-' if r.doc_id is None else r.doc_id}" for c in columns[5:])
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")

    rows = docs.collect()
    model = langid.train(docs.select("doc_id", "text", "lang"))
    lang, score = model.predict([r.text for r in rows])
    want = [(r.doc_id, r.text, r.lang or x) for r, x, v in zip(rows, lang, score) if x != "und" and v >= p.MIN_SCORE]
    one = step("language_id", docs)
    got = one.collect()
    assert one.columns == columns and Counter((r.doc_id, r.text, r.lang) for r in got) == Counter(want) and all(map(own, got)) and len(rows) - 3 >= len(got) > 140

    best = {}
    for r in got:
        best[r.text] = max(best.get(r.text, r), r, key=key)
    two = step("exact_dedup", one)
    got = two.collect()
    assert two.columns == columns and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in best.values()) and all(map(own, got)) and len(got) < one.count()

    plain = [(r.doc_id, r.text) for r in got]
    want = Counter(c for c in {(x[2] if x[2] is not None else x) for x in brute_near(plain, 5, 80)} if isinstance(c, int))
    three = step("near_dedup", two)
    got = three.collect()
    assert three.columns == columns and Counter(r.doc_id for r in got if r.doc_id is not None) == want and all(map(own, got))

    texts = sorted(((r.doc_id, r.text) for r in got), key=lambda x: (x[0] is not None, x[0] or 0))
    four = step("substring_dedup", three)
    got = sorted(four.collect(), key=key)
    assert four.columns == columns and [len(r.text.encode()) for r in got] == [n - gone for n, gone, _, _ in brute_repeats([t for _, t in texts])] and all(map(own, got))
    assert all(r.n_chars == len(r.text) for r in got)

    packed = step("pack", four).toPandas()
    texts = {(None if r.doc_id is None else r.doc_id): r.text for r in got}
    for doc, g in packed.groupby("doc_id"):
        ids = LIB[WORD].encode(texts[doc], add_special_tokens=False).ids + [1]
        assert np.concatenate([np.frombuffer(b, "<u4") for b in g.sort_values("piece").ids]).tolist() == ids
    assert packed.length.groupby(packed.sequence_id).sum().max() <= 4096 and len(packed) >= len(got)
    bins = sorted(sorted(g.length) for _, g in packed.groupby("sequence_id"))
    assert bins == sorted(map(sorted, naive_two_fit(packed.length.tolist(), 4096)))


def test_pipeline_runs(spark, data):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "pack"]
    assert p.run(spark, data).count() > 0
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, data).count() == 0
