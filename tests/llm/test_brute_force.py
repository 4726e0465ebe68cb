"""Operators against plain versions of what they compute."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, difference
from repoatlas.llm import common, language_model, packing, simhash, token_files, unigram_counts, warc
from repoatlas.llm.exact_search import exact_top_k

import edge

SF_DIR = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return given.unionByName(edge.documents(spark).withColumn("doc_id", F.col("doc_id") + 100_000))


def ids_of(path, text, end):
    ids = common.tokenizer(path).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_quality_rules"])
def test_sql(spark, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = connect(SF_DIR).execute(contract.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_sql_on_edge_cases(spark, tmp_path):
    edge.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_mix_sources", "op6_quality_rules"):
        ours = contract.queries()[name](spark, str(tmp_path)).toPandas()
        assert difference(ours, con.execute(contract.oracle_sql()[name]).df()) is None, name


@pytest.mark.parametrize("path,folds", [(BYTE, False), (WORD, True)])
def test_encoder_equals_the_library(path, folds):
    letters = list("aAéÉ1 2  \n\n\t\x1c\x85'sll!?.#|<>🙂́日本ß") + ["<|endoftext|>", " 't", "\r\n"]
    draw = random.Random(3)
    encode = common.TextEncoder(path, folds)
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert encode(text) == ids_of(path, text, 0)[:-1].tobytes(), repr(text)


def test_packing(docs):
    pieces = packing.pack(docs, WORD, True, 2).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        parts[p.doc_id].append(p)
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda p: p.offset)
        assert [p.offset for p in rows] == np.cumsum([0, *(p.length for p in rows)])[:-1].tolist()
        length = sum(p.length for p in rows)
        assert length <= packing.ROOM
        padding += 0 if math.log2(length).is_integer() else packing.ROOM - length
    assert padding <= 0.02 * sum(p.length for p in pieces)
    expected = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        expected[r.doc_id].append(ids_of(WORD, r.text, 2).tobytes())
    for doc_id, texts in expected.items():
        rows = parts[doc_id]
        if len(texts) == 1:
            rows.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in rows) == texts[0]
        assert sum(p.length for p in rows) == sum(len(t) // 4 for t in texts)


def test_best_fill_is_the_closest_sum():
    draw = random.Random(5)
    for _ in range(200):
        room = draw.randint(1, 40)
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(draw.randint(0, 5))}
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.best_fill(counts, room)
        assert all(counts[length] >= n for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= room)


def test_token_files(docs):
    files = token_files.write_token_files(docs, BYTE, False, 0)
    rows = token_files.read_token_files(files).collect()
    found = sorted((r.start, r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in rows)
    expected = sorted(
        (r.doc_id if r.doc_id is not None else -1, len(ids), zlib.crc32(ids.tobytes()))
        for r in docs.collect()
        for ids in [ids_of(BYTE, r.text, 0)]
    )
    assert sorted(f[1:] for f in found) == expected
    assert [f[1] for f in found] == [e[0] for e in expected]
    assert [f[0] for f in found] == np.cumsum([0, *(f[2] for f in found)])[:-1].tolist()
    file = files.first()
    source = token_files.TokenFile(file.folder, file.path)
    text = docs.where(F.col("doc_id") == source.doc_id(1)).first().text
    assert source.document(1).tolist() == ids_of(BYTE, text, 0).tolist()


def test_archives(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    pages = pages.union(pages.limit(9).select(F.col("page_id") + 5_000, "url", "html"))
    archives = warc.write_archives(warc.chunk_table(warc.record_table(pages), 700), 20_000)
    assert archives.count() > 1
    parts = defaultdict(list)
    for r in warc.read_archives(archives, 300).collect():
        parts[r.page_id].append(r)
    first = {}
    given = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for page_id in sorted(given):
        if len(given[page_id]) >= 100:
            first.setdefault(given[page_id], page_id)
    assert parts.keys() == given.keys()
    for page_id, html in given.items():
        rows = sorted(parts[page_id], key=lambda r: r.chunk_no)
        assert rows[-1].last and not any(r.last for r in rows[:-1])
        assert rows[-1].payload_bytes == len(html)
        assert rows[-1].payload_digest == hashlib.sha256(html).hexdigest()
        refers_to = first.get(html, page_id)
        assert rows[0].refers_to == (None if refers_to == page_id else refers_to)
        if refers_to == page_id:
            assert b"".join(bytes(r.chunk) for r in rows) == html
            assert rows[0].payload_digest == hashlib.sha256(html[:300]).hexdigest()


def test_search(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = table.toPandas()
    vectors = np.floor(np.stack(rows.embedding.to_numpy()).astype(np.float64) * 256).astype(int)
    ids = rows.vec_id.to_numpy()
    found = defaultdict(list)
    for r in exact_top_k(table, rows=64, queries=3).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q in np.flatnonzero(ids % 50 == 0):
        scores = vectors @ vectors[q]
        order = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])
        assert found[ids[q]] == [(i, -s) for s, i in order[:5]]


def test_unigram_counts(docs):
    scores = unigram_counts.piece_scores(PIECES)
    floor = min(scores.values()) - unigram_counts.BYTE_PENALTY

    def tokens(word):
        text = "▁" + word.decode()
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + size * floor, -best[end - 1][1] - size)]
            for start in range(max(0, end - 40), end):
                if text[start:end] in scores:
                    options.append((best[start][0] + scores[text[start:end]], -best[start][1] - 1))
            score, n = max(options)
            best.append((score, -n))
        return best[-1][1]

    memo = {}
    found = Counter()
    for r in unigram_counts.token_counts(docs, PIECES).collect():
        found[r.doc_id, r.n_pre_tokens, r.n_tokens] += 1
    expected = Counter()
    for r in docs.collect():
        words = common.utf8(r.text).split()
        for w in set(words) - memo.keys():
            memo[w] = tokens(w)
        expected[r.doc_id, len(words), sum(memo[w] for w in words)] += 1
    assert found == expected
    small = unigram_counts.PrefixTrie(scores, nodes=20)
    for w in list(memo)[:300]:
        assert small.count(w) == memo[w]


def test_fingerprints_and_components(docs):
    def brute(text):
        import xxhash

        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        bits = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                bits[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))

    given = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    # Some more, near to each other.
    label = list(range(len(given)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i in range(len(given)):
        for j in range(i):
            if bin(given[i][1] ^ given[j][1]).count("1") <= 2:
                label[root(i)] = root(j)
    least = {}
    for n, (doc_id, _) in enumerate(given):
        if doc_id is not None:
            least[root(n)] = min(least.get(root(n), doc_id), doc_id)
    expected = sorted(
        ((d, f"{f:016x}", least.get(root(n))) for n, (d, f) in enumerate(given)), key=repr
    )
    assert edge.plain(simhash.near_duplicates(docs)) == expected


def test_links_in_small_tiles(spark):
    draw = random.Random(11)
    values = {draw.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for _ in range(draw.randint(0, 3)):
            values.add(v ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    from repoatlas.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame, 2, tile=2)).collect()}
    label = {v: v for v in signed}
    changed = True
    pairs = [
        (a, b)
        for i, a in enumerate(signed)
        for b in signed[:i]
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    ]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {v: roots.get(v, v) for v in signed} == label


def test_language_scores(docs):
    rows = language_model.language_scores(docs).collect()
    counts, texts = Counter(), Counter()
    for r in docs.collect():
        tokens = [*common.ascii_words(r.text or ""), b"\n"]
        held_out = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1
        texts[r.doc_id, held_out, len(tokens), tuple(tokens)] += 1
        if not held_out:
            counts.update(tokens)
    total = sum(counts.values())
    expected = sorted(
        (
            repr(doc_id),
            held_out,
            n,
            sum(counts[t] > 0 for t in tokens),
            round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in tokens), 4),
        )
        for (doc_id, held_out, n, tokens), times in texts.items()
        for _ in range(times)
    )
    found = sorted(
        (repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows
    )
    assert found == expected
    assert {r.train_tokens for r in rows} == {total}
    assert all(r.score < 0 for r in rows)


def test_coded_tokens_are_a_distribution():
    counts = np.zeros((2, language_model.SLOTS), np.float32)
    mixer = language_model.Mixer()
    words = [bytes([a]) for a in range(256) if a not in b" \n"]
    first = language_model.Events(words)
    bits = np.zeros(len(first))
    for slots, bit in first.bits():
        zeros, ones = (np.stack([counts[side][at] for at in slots]) for side in (0, 1))
        _, gate, p = mixer.predict(zeros, ones)
        p = mixer.refine(gate, p)
        bits -= np.log2(np.where(bit == 1, p, 1 - p))
    # One event for each first byte and one for the end byte after it.
    assert len(first) == 2 * len(words)
    assert abs(sum(2.0 ** -bits) - 254 / 256 - 254 / 256) < 1e-6


def held_out_ids(held_out, count):
    found = (n for n in range(10_000) if (zlib.crc32(str(n).encode()) % 5 == 1) == held_out)
    return [next(found) for _ in range(count)]


def test_language_scores_follow_word_order_and_no_layout(spark):
    sentence = "the old cat sat on the warm mat while it rained outside all day"
    train = held_out_ids(False, 40)
    ordered, turned = held_out_ids(True, 2)
    rows = [(n, " ".join([f"note{n}", sentence, sentence])) for n in train]
    rows += [(ordered, sentence), (turned, " ".join(reversed(sentence.split())))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in language_model.language_scores(docs.repartition(3)).collect()}
    assert round(found[ordered].base_score - found[turned].base_score, 9) == 0
    assert found[ordered].score > found[turned].score + 1
    again = {r.doc_id: r.score for r in language_model.language_scores(docs.coalesce(1)).collect()}
    assert again == {n: r.score for n, r in found.items()}


def test_text_bits_against_one_bit_at_a_time(spark):
    texts = ["a cat sat on a mat", "a mat", "", "caf\u00e9 on a mat a mat", "a cat sat on a mat"]
    raw = [t.encode() for t in texts]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    counts = language_model.context_counts(train)
    mixer = language_model.Mixer()
    random = np.random.default_rng(3)
    mixer.weights = random.uniform(0.1, 0.5, mixer.weights.shape)
    mixer.total = random.uniform(1, 9, mixer.total.shape)
    mixer.hits = mixer.total * random.uniform(0.1, 0.9, mixer.total.shape)

    seen = Counter()
    for text in raw:
        for at, byte in enumerate(text + b"\n"):
            bits = f"{byte:08b}"
            before = (b"\0" * 8 + text)[at + 8 - 8 : at + 8]
            for order, _ in language_model.ORDERS:
                for n in range(8):
                    seen[order, before[8 - order :], bits[:n], bits[n]] += 1
    for left_out in (False, True):
        table = language_model.predictions(counts, left_out)
        for text in raw:
            expected = 0.0
            for at, byte in enumerate(text + b"\n"):
                bits = f"{byte:08b}"
                before = (b"\0" * 8 + text)[at + 8 - 8 : at + 8]
                for half in (0, 4):
                    known = [
                        sum(seen[o, before[8 - o :], bits[:half], b] for b in "01") - left_out
                        for o, _ in language_model.ORDERS
                    ]
                    long, _ = mixer.levels(np.array(known[language_model.LONG]))
                    _, middle = mixer.levels(np.array(known[language_model.MIDDLE]))
                    gate = np.array([long * 5 + middle])
                    for n in range(half, half + 4):
                        x = []
                        for o, _ in language_model.ORDERS:
                            zeros, ones = (
                                seen[o, before[8 - o :], bits[:n], b] - (left_out and b == bits[n])
                                for b in "01"
                            )
                            x.append(math.log((ones + 0.4) / (zeros + 0.4)))
                        p = mixer.squash(np.array([np.dot(x, mixer.weights[gate[0]])]))
                        p = mixer.refine(gate, p)[0]
                        expected -= math.log2(p if bits[n] == "1" else 1 - p)
            events = language_model.Events([text], places=True)
            if left_out:
                found = 0.0
                for rows, value in events.halves():
                    inputs, gate = language_model.inputs_of(rows, value, table, True)
                    mixed = mixer.mix(inputs, gate, mixer.weights.T)
                    p = mixer.refine(gate[:, None], mixer.squash(mixed))
                    p = np.where(language_model.BITS[value] == 1, p, 1 - p)
                    found -= np.log2(p).sum(axis=1)
            else:
                found = language_model.event_bits(events, table, mixer)
            assert abs(events.per_text(found)[0] - expected) < 1e-3 * max(1, expected)


def test_events_are_shared_in_a_block_and_summed_by_text():
    texts = [b"", b"ab ab ab ab ab ab", b"x", b"ab ab ab ab ab ab", b"\0\xff" * 9]
    events = language_model.Events(texts, places=True)
    assert events.times.sum() == sum(len(t) + 1 for t in texts) > len(events)
    values = np.random.default_rng(1).random(len(events))
    of = dict(zip(events.strings.tolist(), values.tolist()))
    for text, found in zip(texts, events.per_text(values)):
        expected = 0.0
        for at, byte in enumerate(text + b"\n"):
            before = (b"\0" * 7 + text)[at : at + 7]
            expected += of[int.from_bytes(before[::-1] + bytes([byte]), "big")]
        assert abs(found - expected) < 1e-9
    alone = language_model.Events(texts)
    assert alone.strings.tolist() == events.strings.tolist()
    assert alone.times.tolist() == events.times.tolist()


def test_blocks_do_not_follow_batches(monkeypatch):
    monkeypatch.setattr(language_model, "TEXT_BLOCK", 20)
    texts = [None, "A b", "c" * 30, "", "d e f", "g " * 15, "h"]

    def cut(sizes):
        given = iter(enumerate(texts))
        batches = []
        for size in sizes:
            rows = [next(given) for _ in range(size)]
            batches.append({"doc_id": [n for n, _ in rows], "text": [t for _, t in rows]})
        return [(t, r["doc_id"]) for t, r in language_model.text_blocks(batches)]

    blocks = cut([7])
    assert len(blocks) > 1 and blocks == cut([1, 2, 4]) == cut([3, 0, 4])
    assert [n for _, ids in blocks for n in ids] == list(range(7))
    assert blocks[0][0][:2] == [b"", b"a b"]


def test_classifier_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = contract.queries()["op8_quality_classifier"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.85


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert len(kept["quality classifier"]) <= len(kept["quality rules"]) < 200
    assert max(kept["near duplicates"].values()) == 1
    words = sum(len(common.utf8(r.text).split()) for r in docs.collect())
    before = corpus_pipeline.STAGES[:3]
    again = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in before:
        again = stage(spark, again, SF_DIR)
    size = sum(len(common.utf8(r.text).split()) for r in again.collect())
    assert abs(words - 1.5 * size) <= 20
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    tokens = sum(len(ids_of(WORD, r.text, 2)) for r in docs.collect())
    assert sum(p.length for p in pieces) == tokens


def test_near_duplicates_stage_keeps_one_of_each_component(spark, docs):
    """One row stays for each class that op9 finds: the one with the smallest id."""
    classes = simhash.near_duplicates(docs)
    expected = Counter(r.component_id for r in classes.select("component_id").distinct().collect())
    kept = corpus_pipeline.dedup_stage(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == expected


def test_near_duplicates_stage_on_a_large_group(spark):
    """Two thousand near copies are one class, linked by fewer edges than members."""
    draw = random.Random(11)
    words = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    rows = []
    for n in range(2000):
        near = list(words)
        near[draw.randrange(len(near))] = f"edit{n}"
        rows.append((n + 5, " ".join(near)))
    rows += [(2, "another text altogether that stays"), (3, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fps = simhash.fingerprints(docs).select("fp").distinct()
    assert simhash.links(fps).count() < 4 * fps.count()
    members = [r.doc_id for r in simhash.near_duplicates(docs).where("component_id = 5").collect()]
    kept = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, SF_DIR).collect()]
    assert sorted(kept) == sorted([2, 3, *({r[0] for r in rows if r[0] > 4} - set(members)), 5])
    assert len(members) > 1900
