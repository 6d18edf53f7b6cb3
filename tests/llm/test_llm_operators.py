"""Training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from hourgrid.llm import bpe, common, fingerprint, langid, line_dedup, near_dup, tiling, token_counts, token_files, toxicity, url_reputation  # noqa: E402
from hourgrid.llm.common import vocabulary_path  # noqa: E402
from hourgrid.llm.components import components  # noqa: E402
from hourgrid.sources.scratch import scratch_path  # noqa: E402

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. "
AWKWARD = [
    (1, "The quick brown fox <|endoftext|> 123abc it's 中文 \x1c\x85 ٣", "x"),
    (1, "The quick brown fox <|endoftext|> 123abc it's 中文 \x1c\x85 ٣", "x"),
    (2, "", None),
    (3, None, "y"),
    (None, "no id here. Ends\n\nso", None),
    (4, "a" * 3000 + " " + "ab" * 900 + "  \n" + LONG * 60, "z"),
    (5, " ", ""),
    (6, "word", ""),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture
def docs(spark):
    """Copies, nulls, an empty and a long text, and a column whose name the operators use too."""
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def test_token_counts(docs, nothing):
    encode = tokenizer("byte_bpe_50k.json").encode
    found = token_counts.add_token_counts(docs, vocabulary_path("byte_bpe_50k.json"), 100)
    size = [len(encode(t or "", add_special_tokens=False).ids) for _, t, _ in AWKWARD]
    expected = [(i, len((t or "").encode()), n, n > 100) for (i, t, _), n in zip(AWKWARD, size)]
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=str)
    assert token_counts.add_token_counts(nothing, vocabulary_path("byte_bpe_50k.json"), 1).count() == 0


@pytest.mark.parametrize("text", [LONG * 50, "ab1" * 500, "x" * 900, " \n\t" * 400, "a  b\n\nc" * 200])
def test_pieces_of_long_texts_count_like_the_whole(text):
    encode = tokenizer("byte_bpe_50k.json").encode
    pieces = list(token_counts.split_long(text, 64))
    assert "".join(pieces) == text
    assert sum(len(encode(p).ids) for p in pieces) == len(encode(text).ids)


def test_byte_bpe_equals_tiktoken(docs, nothing):
    import tiktoken

    path = vocabulary_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    decoded = rows(bpe.decode_documents(encoded, path), "doc_id", "ids", "data")
    ids = [np.array(known.encode_ordinary(t or ""), "<u4").tobytes() for _, t, _ in AWKWARD]
    plain = [(i, bytearray(x), bytearray((t or "").encode())) for (i, t, _), x in zip(AWKWARD, ids)]
    assert decoded == sorted(plain, key=str)
    digests = [(i, len(x) // 4, hashlib.sha256(x).hexdigest()) for (i, _, _), x in zip(AWKWARD, ids)]
    assert rows(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256") == sorted(digests, key=str)
    assert bpe.round_trip(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_yields_lowest_rank_then_leftmost():
    queue, entries = bpe.RankQueue(), [(50_000, 3), (7, 9), (7, 2), (64, 1), (4_096, 0), (7, 5)]
    for entry in entries:
        queue.push(*entry)
    assert [queue.pop() for _ in entries] == sorted(entries)
    assert queue.pop() is None


def test_fingerprints_of_edits_and_neighbours(docs, nothing):
    found = {r["n_chars"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    ordered = sorted(((i, t or "") for i, t, _ in AWKWARD), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sum(len(t) for _, t in ordered) == fingerprint.fingerprint_documents(docs).agg(F.sum("n_chars")).first()[0]
    for (_, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        if len(text) > 4:
            cut = len(text) // 3
            copy = [t for _, t in ordered].count(text) > 1
            digest = hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
            assert copy or found[len(text)]["edited_sha256"] == digest
    assert fingerprint.fingerprint_documents(nothing).count() == 0


def test_fingerprints_equal_a_walk_through_the_rows(spark):
    """Every row with what follows it, a third of them of one id and a third without."""
    table = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{'é' * (i % 5)} word{i % 19}. Same line\nof {i % 4}" * (i % 6)) for i in range(150)]
    ordered = sorted(table, key=lambda r: r[1], reverse=True)
    ordered.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, new = (fingerprint.to_text(p) for p in fingerprint.fingerprints([text, edited]))
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new))
    found = fingerprint.fingerprint_documents(spark.createDataFrame(table, "doc_id long, text string"))
    assert rows(found, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint") == sorted(expected, key=str)
    assert found.where("near_edited < 0 OR near_edited > 1 OR near_next < 0 OR near_next > 1").count() == 0


def test_fingerprints_are_homomorphic():
    a, b = (fingerprint.to_text(fingerprint.fingerprints([t])[0]) for t in ("one\ntwo", "two\none"))
    three = fingerprint.to_text(fingerprint.fingerprints(["one\ntwo\nthree"])[0])
    assert a == b
    assert fingerprint.insert(a, "three") == three and fingerprint.delete(three, "three") == a
    assert fingerprint.combine(a, fingerprint.to_text(fingerprint.fingerprints(["three"])[0])) == three


@pytest.mark.parametrize("n", [1, 5, 1024, 5000, 300_000])
def test_block_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    frequency = token_files.shares(np.bincount(ids, minlength=50_000))
    block = token_files.encode_block(ids, frequency, every=16)
    assert (token_files.decode_block(block, frequency) == ids).all()
    assert (token_files.decode_block(block, frequency, n // 3, n // 2 + 1) == ids[n // 3 : n // 2 + 1]).all()
    # The stored checksum, and where all lanes are in use the lowest byte of the first lane's state.
    for place in [24] + [32] * (n >= 1024):
        broken = bytearray(block)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_block(bytes(broken), frequency)


def test_token_files(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 256)  # the long text spans blocks
    path = scratch_path(spark, "files")
    name = vocabulary_path("word_bpe_49k.json")
    token_files.write_token_files(docs, path, name, 2)
    found = rows(token_files.read_token_files(spark, path), "start", "n_tokens", "ids_crc32")
    encode, start, expected = tokenizer("word_bpe_49k.json").encode, 0, []
    for _, text in sorted(((i, t or "") for i, t, _ in AWKWARD), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ids = encode(text, add_special_tokens=False).ids + [2]
        expected.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == sorted(expected, key=str)
    empty = scratch_path(spark, "files")
    token_files.write_token_files(nothing, empty, name, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_remembered_words_do_not_change_ids(monkeypatch):
    """Words met again after others have pushed them out, and words too long to be remembered."""
    encode = tokenizer("word_bpe_49k.json").encode
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 40)
    ids = token_files._WordIds(vocabulary_path("word_bpe_49k.json"))
    for k in range(30):
        text = " ".join(f"word{'abcdefghij'[(k * i) % 10]}ing, it's {i % 7}" for i in range(30)) + " " + "verylong" * 20
        assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == encode(text, add_special_tokens=False).ids
    assert len(ids) + len(ids.earlier) < 200 and not any(len(w) > 64 for w in ids)


def test_remembered_pieces_do_not_change_ids():
    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_50k.tiktoken"))
    pieces = [f" word{i % 37}x{i % 11}" for i in range(500)] + ["z" * 300]
    few = bpe.PieceIds(ranks, 20)
    assert [few[p] for p in pieces] == [np.array(bpe.merge_piece(p.encode(), ranks), "<u4").tobytes() for p in pieces]
    assert len(few) + len(few.earlier) <= 20


def test_texts_come_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["", None, "abc", "é" * 20, "x" * 9, "y", "z", "w" * 10, None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[:5])}), pa.RecordBatch.from_pydict({"text": pa.array(texts[5:])})]
    parts = [p.column("text").to_pylist() for p in common.sliced(iter(batches))]
    assert [t for p in parts for t in p] == texts
    assert all(sum(len((t or "").encode()) for t in p) <= 10 or len(p) == 1 for p in parts)


def test_joined_checksums():
    data = bytes(range(256)) * 9000
    cuts = [0, 1, 77, 1_500_000, len(data)]
    parts = [(b - a, zlib.crc32(data[a:b])) for a, b in zip(cuts, cuts[1:])]
    assert token_files.joined_crc(parts) == zlib.crc32(data)


def brute_components(texts, percent=85):
    sets = [frozenset(near_dup.shingle_set(t or "").tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [min(k for k, g in enumerate(group) if g == own) for own in group], [len(s) for s in sets]


@pytest.mark.parametrize("short, percent", [(2, 85), (64, 85), (2, 80), (64, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, short, percent):
    """Short lists of two force nearly all groups through cores, pivots and lists of differences."""
    monkeypatch.setattr(near_dup, "SHORT_LIST", short)
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in draw.integers(0, 500, 150)]
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", "  ", "Two words", "two WORDS", " ".join(base)]
    for k in range(60):
        words = list(base)
        for at in draw.integers(0, 150, k % 5):
            words[at] = f"n{draw.integers(0, 40)}"
        texts.append(" ".join(words[: 150 - (k % 7) * (k % 3) * 4]))
        texts.append(" ".join(passage + [f"q{draw.integers(0, 30)}" for _ in range(k % 12)]))
        texts.append(" ".join(f"w{i}" for i in draw.integers(0, 500, 40)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(near_dup.near_duplicates(docs, Fraction(percent, 100)), "doc_id", "n_shingles", "component_id", "kept")
    expected, sizes = brute_components(texts, percent)
    assert found == sorted(((i, n, c, c == i) for i, (c, n) in enumerate(zip(expected, sizes))), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_links_of_whole_sketches_to_larger_sets(spark, seed):
    """Texts of 32 or 33 shingles and longer copies of each; only the first words are shared."""
    draw, texts = np.random.default_rng(seed), []
    for k in range(120):
        base = [f"d{seed}k{k}w{i}" for i in range(36 + int(draw.integers(0, 2)))]
        texts += [" ".join(base), " ".join(base + [f"d{seed}k{k}x{i}" for i in range(5 - k % 3)])]
    # The five highest values are the shorter text's, so the longer one's sketch lacks them.
    worst = 0
    while worst < 3:
        words = [f"s{seed}v{draw.integers(1 << 40)}" for _ in range(41)]
        values = near_dup.shingles(near_dup._WORDS.of(" ".join(words)), near_dup.WIDTH)
        if (np.argsort(values)[-5:] < 32).all():
            texts += [" ".join(words[:36]), " ".join(words)]
            worst += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(near_dup.near_duplicates(docs), "doc_id", "component_id")
    assert found == sorted(enumerate(brute_components(texts)[0]), key=str)


def test_large_group_of_near_copies_equals_brute_force(spark, monkeypatch):
    """One group of near copies whose lists are all long, some of it linked only through others."""
    monkeypatch.setattr(near_dup, "SHORT_LIST", 12)
    draw = np.random.default_rng(11)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for k in range(160):
        words = list(base)
        for _ in range(int(draw.integers(0, 9))):
            at = int(draw.integers(0, len(words)))
            words[at : at + int(draw.integers(0, 3))] = [f"n{draw.integers(0, 60)}"]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(near_dup.near_duplicates(docs), "doc_id", "component_id")
    expected = brute_components(texts)[0]
    assert 1 < len(set(expected)) < len(texts)
    assert found == sorted(enumerate(expected), key=str)


def test_very_long_lines_that_differ_by_a_word(spark):
    """Work grows with the words of a line, not with their square."""
    words = [f"w{i % 977}x{i}" for i in range(100_000)]
    changed, longer = list(words), list(words)
    changed[70_000] = "other"
    longer.insert(10, "more")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(longer)), (4, " ".join(words[::-1]))], "doc_id long, text string")
    found = rows(line_dedup.duplicate_lines(docs), "doc_id", "first_doc_id", "edits")
    assert found == [(2, 1, 1), (3, 1, 1)]


def test_near_duplicates_of_awkward_rows(docs, nothing):
    kept = near_dup.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert near_dup.near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(41)}


def brute_lines(texts):
    seen, dropped = [], []
    for doc, text in enumerate(texts):
        for no, line in enumerate((text or "").split("\n")):
            words = line.lower().split()
            if words:
                near = [edit_distance(words, w) for w in seen if words == w or min(len(words), len(w)) >= 8]
                if any(d <= 1 for d in near):
                    dropped.append((doc, no))
                seen.append(words)
    return dropped


def edit_distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_brute_force(spark):
    draw = np.random.default_rng(2)
    lines = [[f"w{i}" for i in draw.integers(0, 30, draw.integers(1, 14))] for _ in range(30)]
    texts = [None, "", " \n\t"]
    for _ in range(40):
        own = []
        for i in draw.integers(0, 30, 4):
            words, at = list(lines[i]), int(draw.integers(0, len(lines[i])))
            edit = draw.integers(0, 5)
            if edit == 0:
                words[at] = "new"
            elif edit == 1:
                words.insert(at, "more")
            elif edit == 2 and len(words) > 1:
                del words[at]
            own.append(" ".join(words).upper() if edit == 3 else "  ".join(words))
        texts.append("\n".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [tuple(r) for r in line_dedup.duplicate_lines(docs).select("doc_id", "line_no").collect()]
    assert sorted(found) == brute_lines(texts)


def test_line_dedup_keeps_clean_rows(docs, nothing):
    kept = line_dedup.drop_duplicate_lines(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IN (1, 2, 3, 5, 6) OR doc_id IS NULL").count() == 7
    assert line_dedup.drop_duplicate_lines(nothing).count() == 0


def test_tiling_finds_reordered_passages(spark, docs):
    item = [f"b{i}" for i in range(40)]
    texts = [" ".join(item[20:] + ["gap"] + item[:20]), " ".join(item[:12]), None, "", "x, " + ", ".join(item).upper()]
    table = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, "a")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in tiling.contaminated(table, items).collect()}
    assert found == {(0, 7, 1.0, 2), (None, 7, 1.0, 2), (4, 7, 1.0, 1)}
    assert {r["doc_id"] for r in tiling.drop_contaminated(table, items).collect()} == {1, 2, 3}
    assert tiling.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert tiling.contaminated(docs.limit(0), items).count() == 0


def test_tiles_are_greedy_and_do_not_overlap():
    item, doc = np.arange(30, dtype=np.uint64), np.r_[np.arange(5, 20), 99, np.arange(0, 12), np.arange(20, 30)].astype(np.uint64)
    found = tiling.tiles(item, doc)
    assert found == [(5, 0, 15), (20, 28, 10), (0, 16, 5)]


def test_languages(spark, nothing):
    words = {"xx": ["kolo", "mira", "tuna"], "yy": ["szcz", "wrzy", "prze"]}
    train = [(lang, " ".join(w * 20)) for lang, w in words.items()] + [(None, "kolo"), ("xx", None)]
    filters = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    table = spark.createDataFrame([(1, "Kolo mira!"), (2, "prze szcz"), (3, "12 ?"), (4, None), (5, ""), (None, "q")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, filters).collect()}
    assert found[1][0] == "xx" and found[2][0] == "yy" and found[None][0] in words
    assert found[3] == found[4] == found[5] == ("und", 0.0)
    assert langid.identify(nothing, filters).count() == 0
    assert langid.learn(nothing.withColumn("lang", F.lit("xx"))).languages == []


def test_toxic_sentences_are_found(spark, docs, nothing):
    draw = np.random.default_rng(0)
    clean = [" ".join(f"w{i}" for i in draw.integers(0, 60, 30)) + "." for _ in range(300)]
    rows_ = [(i, t + (" Vile wretch here." if i % 5 == 0 else " Fine."), int(i % 5 == 0)) for i, t in enumerate(clean)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, label int")
    model = toxicity.fit(table, table.select("doc_id", "label"))
    found = toxicity.score_documents(table, model).join(table, "doc_id").collect()
    assert all(r["predicted"] == r["label"] for r in found)
    assert all("Vile" in r["text"][r["worst_start"] : r["worst_end"]] for r in found if r["label"])
    scores = toxicity.score_documents(docs, model)
    assert scores.count() == docs.count() and scores.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score_documents(nothing, toxicity.fit(table, table.select("doc_id", "label").limit(0))).count() == 0


def test_gradient_of_noisy_or():
    draw = np.random.default_rng(1)
    label, ids, sentence = np.array([1, 0, 1]), draw.integers(0, 4, 12), np.sort(draw.integers(0, 5, 12))
    owner, weights = np.array([0, 0, 1, 2, 2]), draw.normal(size=4)
    _, slope, shift = toxicity.loss_and_gradient(label, ids, sentence, owner, weights, -0.5)
    for k in range(5):
        step = 1e-6 * (np.arange(5) == k)
        up, down = (toxicity.loss_and_gradient(label, ids, sentence, owner, weights + s * step[:4], -0.5 + s * step[4])[0] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(np.r_[slope, shift][k], abs=1e-5)


def test_urls_follow_rules_then_reputation(spark):
    outcomes = [("bad.site.org", 1)] * 60 + [("good.other.org", 0)] * 200 + [("new.site.org", 1), (None, 1), ("x.org", None)]
    known = url_reputation.host_reputation(spark.createDataFrame(outcomes, "host string, bad int"))
    rules = [url_reputation.Rule("allow", "com", "/"), url_reputation.Rule("block", "example.com", "/en/")]
    urls = ["http://BAD.site.org/x", "https://good.other.org", "http://www.example.com/en/1?q", "http://example.com", "ftp://a.com/en/", "nothing", None, "://h#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(pages, rules, known).collect()}
    assert found == {
        0: ("bad.site.org", "/x", None, "block"),
        1: ("good.other.org", "", None, "allow"),
        2: ("www.example.com", "/en/1", "example.com/en/", "block"),
        3: ("example.com", "", None, "allow"),
        4: ("a.com", "/en/", "com/", "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("h", "", None, "allow"),
    }
    shares = {r["host"]: r["posterior_mean"] for r in known.collect()}
    assert shares["bad.site.org"] < 1 and shares["good.other.org"] < shares["new.site.org"] < 1


def test_pipeline_equals_brute_force(spark):
    """The stages one after another in plain Python, with the model that the first stage learns."""
    import tiktoken

    import corpus_pipeline
    from hourgrid.llm import catalogue

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(table, toxicity.labels_to_learn(spark.read.parquet(f"{sf}/labels.parquet")))
    scores = toxicity._Scores(model.weights)
    docs = sorted((r["doc_id"], r["text"]) for r in table.collect())
    docs = [(i, t) for i, t in docs if toxicity.judge(t or "", scores, model.bias)[0] < toxicity.THRESHOLD]
    lost = {}
    for place, no in brute_lines([t for _, t in docs]):
        lost.setdefault(place, set()).add(no)
    kept = []
    for place, (i, text) in enumerate(docs):
        if place in lost:
            stay = [line for no, line in enumerate(text.split("\n")) if no not in lost[place]]
            if not any(line.split() for line in stay):
                continue
            text = "\n".join(stay)
        kept.append((i, text))
    first, _ = brute_components([t for _, t in kept], 80)
    docs = [d for k, d in enumerate(kept) if first[k] == k]
    items = [tiling.tokens(r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    covered = lambda words, item: sum(n for *_, n in tiling.tiles(item, words)) / max(1, len(item)) >= tiling.COVERAGE
    docs = [(i, t) for i, t in docs if not any(covered(tiling.tokens(t or ""), item) for item in items)]
    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = [(i, len(x := known.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, t in docs]
    assert rows(catalogue.pipeline(spark, sf), "doc_id", "n_tokens", "ids_sha256") == sorted(expected, key=str)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None
