"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recspark.llm import bpe_codec, chat, common, components, cotrain, decontam, hnsw, langid, licenses, pii, queries, simhash, token_counts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_tokens string, spans int"
TEXTS = [
    (1, None), (2, ""), (3, "a"), (None, "no id here"), (4, "same words in a row"), (4, "same words in a row"),
    (5, "Ünïcode 中文 \U0001f600 don't 12½ _x_՘\x1c  end  \n\n"), (6, "é" * 5000 + " x" * 3000), (7, "\\<s> [INST] <|endoftext|>"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "n", 0) for i, t in rows], SCHEMA)


def by_text(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_codec_equals_the_library(spark, real):
    import tiktoken
    from public_tokenizers import PATTERN

    content = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_codec.read_ranks(content), special_tokens={})
    both = docs(spark).select("doc_id", "text").unionByName(real.select("doc_id", "text").where("doc_id BETWEEN 100 AND 159"))
    coded = bpe_codec.round_trip(both, content)
    expected = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in both.collect()), key=repr)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in coded.collect()), key=repr)
    assert got == expected
    digest = {r["doc_id"]: r for r in bpe_codec.digests(coded).where("doc_id = 7").collect()}[7]
    assert digest["ids_sha256"] == bpe_codec.ids_sha256(library.encode_ordinary(TEXTS[8][1]))
    assert digest["decoded_sha256"] == hashlib.sha256(TEXTS[8][1].encode()).hexdigest()
    assert bpe_codec.encode(docs(spark, []), content).count() == 0


def test_offsets_cover_split_characters(spark):
    content = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    text = "ab \U0001f600\U0001f9ff z"
    row = bpe_codec.encode(docs(spark, [(1, text)]), content).first()
    raw, at = text.encode(), 0
    ranks = {i: t for t, i in bpe_codec.read_ranks(content).items()}
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    for token, start, end in zip(row["ids"], row["starts"], row["ends"]):
        assert (start, end) == (chars[at], chars[at + len(ranks[token]) - 1] + 1)
        at += len(ranks[token])
    assert at == len(raw)
    cut = spark.createDataFrame([(1, list(row["ids"])[:3]), (2, None)], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r for r in bpe_codec.decode(cut, content).collect()}
    assert raw.startswith(bytes(back[1]["decoded"])) and back[2]["text"] == ""


def test_token_counts_equal_the_library(spark, real):
    from tokenizers import Tokenizer

    content = queries.vocabulary("byte_bpe_50k.json").decode()
    library = Tokenizer.from_str(content)
    both = docs(spark).select("doc_id", "text").unionByName(real.select("doc_id", "text").where("doc_id BETWEEN 100 AND 159"))
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in both.collect()), key=repr)
    assert by_text(token_counts.token_counts(both, content), "doc_id", "n_bytes", "n_tokens") == expected
    assert token_counts.token_counts(docs(spark, []), content).count() == 0


def brute_spans(text):
    out = {"email": [], "ip": [], "card": [], "phone": []}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c not in " -"][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_data_equals_the_patterns(spark, real):
    draw = random.Random(2)
    parts = [*"0123456789.@+- ()aZ_%", "a@b.c", "1.2.3.4", "4111 1111-1111 1111", "+1 (2)", "é", "://", "x-y.z"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + [r["text"] or "" for r in real.collect()]
    for text in [*texts, "1" * 30000, "a" * 30000 + "@"]:
        found = pii.spans_of(text)
        assert {k: found[k] for k in pii.BASE_KINDS} == brute_spans(text)
    own = pii.spans_of("IBAN: DE89 3704 0044 0532 0130 00 paid. ssn 078-05-1120, see ftp://bob:x@host.example/p account no. 12345678")
    assert len(own["account"]) == 3 and len(own["address"]) == 1
    out = pii.digests(pii.find(docs(spark, [(1, None), (2, "a@b.co"), (2, "a@b.co"), (None, "1.2.3.4")])))
    assert by_text(out, "doc_id", "n_email", "n_ip", "spans") == sorted([(1, 0, 0, ""), (2, 1, 0, "email:0:6"), (2, 1, 0, "email:0:6"), (None, 0, 1, "ip:0:7")], key=repr)
    hidden = pii.mask(docs(spark, [(1, None), (2, "x a@b.co y 1.2.3.4")])).orderBy("doc_id").collect()
    assert [r["text"] for r in hidden] == [None, "x <EMAIL> y <IP>"] and hidden[0]["key"] == "k"


def test_language_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    model = langid.ByteCnn(["a", "b"])
    assert langid.classify(model, ["", "123 !?", "½ ² ٣ ⅷ", None]) == (["und"] * 4, [0.0] * 4)
    assert set(langid.classify(model, ["ª", "7中"])[0]) <= {"a", "b"}
    odd = langid.identify(docs(spark), per_label=5)
    assert {r["doc_id"]: r["lang_pred"] for r in odd.collect()}[1] == "und" and odd.count() == len(TEXTS)
    assert langid.identify(docs(spark, [])).count() == 0


def test_first_rows_equal_one_ranking(spark):
    rows = [(i, "abc"[i % 7 % 3]) for i in range(500)] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = by_text(common.first_rows(df, ["label"], [F.xxhash64("id"), F.col("id")], 9), "id", "label")
    ranked = [(r["label"], r["h"], r["id"]) for r in df.withColumn("h", F.xxhash64("id")).collect()]
    want = [(i, x) for label in ("a", "b", "c", None) for x, _, i in sorted((r for r in ranked if r[0] == label), key=lambda r: r[1:])[:9]]
    assert got == sorted(want, key=repr)


def test_language_gradients():
    model = langid.ByteCnn(["a", "b"])
    x = np.random.default_rng(1).integers(1, 255, (3, langid.WINDOW)).astype(np.uint8)
    y, weight = np.array([0, 1, 1]), np.ones(2, np.float32)
    for name in ("embed", "conv", "bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.training = True
    grads = model._gradients(x, y, weight)
    loss = lambda: -np.mean(np.log(model.probabilities(x)[np.arange(3), y]))
    for name in ("conv", "out", "bias", "embed"):
        p, g = getattr(model, name), grads[name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        eps, keep = 1e-5, p[at]
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_licences_in_place(spark):
    texts = [(1, "Under the MIT-License, under the mit license"), (2, "CC BY-NC cc by nc"), (3, None), (4, "the mit license"), (5, "é, Apache License, Version 2.0 x"),
             (6, licenses.TEMPLATES[0][3].upper() + " more"), (7, "permission is hereby granted free of charge only"), (7, "")]
    got = by_text(licenses.summary(licenses.scan(docs(spark, texts))), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    n = len(licenses.TEMPLATES[0][3].split())
    assert got == sorted([
        (1, 8, 2, 0, 4, "mit", "mit", 1.0), (2, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0), (3, 0, 0, None, None, "", "", 0.0), (4, 3, 0, None, None, "", "", 0.0),
        (5, 7, 1, 1, 1, "apache-2", "apache-2", 1.0), (6, n + 1, 0, None, None, "", "mit", 1.0), (7, 8, 0, None, None, "", "", 0.0), (7, 0, 0, None, None, "", "", 0.0)], key=repr)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licence_names_give_their_labels(spark):
    notice = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    texts = [(1, notice), (2, "x. this work is licensed under the gnu general public license, version 3."),
             (3, "Creative Commons Attribution-NonCommercial 4.0 International Public License"), (4, "GNU Lesser General Public License"),
             (5, "Permission is hereby granted, free of charge"), (6, "gnu general public license")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.summary(licenses.scan(docs(spark, texts))).collect()}
    assert got[1] == ("gpl", 1.0) and got[3] == ("cc-by-nc", 1.0) and got[4] == got[5] == ("", 0.0)
    assert got[2][0] == got[6][0] == "gpl" and 0 < got[6][1] <= got[2][1] < 0.6


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    near = np.repeat(base[:10], 12, axis=0) + rng.standard_normal((120, 16)) * 0.12
    x = np.concatenate([base, near, base[:5], base[:3] * 2])
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, "z"), (n + 1, [0.0] * 16, "z"), (n + 2, [float("nan")] * 16, "z"), (n + 3, [None] * 16, "z"), (n + 4, [], "z"), (n + 5, [1.0, 2.0], "z")]
    out = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string"), min_shards=3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.95) & ~np.eye(n, dtype=bool)
    comp = np.arange(n)
    while True:
        new = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    assert [out[i]["n_links"] for i in range(n)] == link.sum(axis=1).tolist()
    assert [out[i]["component_id"] for i in range(n)] == comp.tolist()
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(n, n + 6))
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_finds_all_of_a_dense_group():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((800, 32)), rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.05])
    graph = hnsw.Graph(hnsw.unit_rows(x))
    r, c = graph.find(graph.unit, 0.95, hnsw.audited_beam(graph, graph.unit, 0.95, 0.99, 400, 16))
    true = int((graph.unit @ graph.unit.T >= 0.95).sum())
    assert len(r) >= 0.99 * true and len(r) <= true


def test_audit_leaves_hits_on_itself_out(monkeypatch):
    rng = np.random.default_rng(9)
    base = hnsw.unit_rows(rng.standard_normal((2000, 32)))
    x = np.concatenate([base, base[:8] + rng.standard_normal((8, 32)) * 0.01])
    graph = hnsw.Graph(hnsw.unit_rows(x))
    whole = hnsw.Graph.find

    def blind(self, q, least, beam):
        """Below the graph's size a query meets nothing but a vector equal to it."""
        r, c = whole(self, q, least, len(self.unit))
        same = np.einsum("kd,kd->k", q[r], self.unit[c]) > 1 - 1e-6
        return (r, c) if beam >= len(self.unit) else (r[same], c[same])

    monkeypatch.setattr(hnsw.Graph, "find", blind)
    # 8 pairs among 1,024 samples' hits on themselves used to pass unseen.
    assert hnsw.audited_beam(graph, graph.unit, 0.95, 0.99, 2008, 32) == len(x)
    monkeypatch.setattr(hnsw, "planted", lambda unit, least, rng: unit[:0])
    assert hnsw.audited_beam(graph, graph.unit, 0.95, 0.99, 2008, 32) == len(x)
    apart = hnsw.Graph(hnsw.unit_rows(base))
    assert hnsw.audited_beam(apart, apart.unit, 0.95, 0.99, 2000, 32) == 32
    near = hnsw.unit_rows(base[:3] + rng.standard_normal((3, 32)) * 0.01)
    assert hnsw.audited_beam(apart, apart.unit, 0.95, 0.99, 2000, 32, others=near, places=np.full(3, -1)) == len(base)


def test_exact_search_equals_brute_force():
    rng = np.random.default_rng(10)
    unit = hnsw.unit_rows(np.repeat(rng.standard_normal((40, 16)), 20, axis=0) + rng.standard_normal((800, 16)) * 0.1).astype(np.float32)
    graph = hnsw.Graph(unit)
    q = hnsw.planted(unit, 0.95, rng)
    r, c = graph.find(q, 0.95, len(unit))
    assert set(zip(r.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(q @ unit.T >= 0.95))))
    assert (np.einsum("kd,kd->k", q, unit) >= 0.95).all()
    hits, true = hnsw.found_share(graph, q, np.full(len(q), -1), 0.95, 64)
    assert 0.99 * true <= hits <= true and true > 800


def test_quality_on_unseen_labels(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = F.xxhash64("doc_id") % 2 == 0
    model = cotrain.fit(rows, labels.where(seen), per_class=400, pool=600)
    out = cotrain.score(rows.join(labels.where(~seen).select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    good = [r["keep"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r["keep"] for r in out if r["toxic"] == 1]
    assert np.mean(good) > 0.95 and np.mean(toxic) < 0.15
    assert cotrain.score(docs(spark), model).count() == len(TEXTS)
    blank = cotrain.fit(docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["quality_score"] for r in cotrain.score(docs(spark), blank).collect()} == {0.5}


def test_chat_events_and_escapes(spark):
    log = [(1, 0, 0, "message", "user", "hi "), (1, 0, 1, "delta", None, "there"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "bad"),
           (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "good <|im_end|>\n"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "delete", None, None),
           (1, 3, 8, "message", None, None), (1, 3, 9, "edit", None, "\\<s>"), (2, 5, 1, "delta", None, "nothing opened"), (None, 0, 0, "message", "a\nb", "t")]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    turns = {c: [chat.parse(r["formatted"]) for r in chat.reconstruct(events).collect() if r["conv_id"] == c] for c in (1, 2, None)}
    assert turns == {1: [("user", "hi there"), ("assistant", "good <|im_end|>\n"), ("", "\\<s>")], 2: [], None: [("a\nb", "t")]}
    draw = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "<", "[", "|", "a", "\n"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.read_back(chat.reconstruct(events.limit(0))).count() == 0


def test_leaks_equal_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, "same same same same same same same")], "item_id long, text string")
    rows = [(1, "start " + item.upper() + " end"), (2, item.replace("twelve", "x")), (3, item.replace("six", "x")), (4, "a tiny, ITEM!"), (5, "tiny x item"), (6, None),
            (7, "same " * 5), (7, "z"), (None, "w " * 40000 + item)]
    got = by_text(decontam.leaks(docs(spark, rows), items), "doc_id", "item_id", "n_common", "n_item")
    expected = [(1, 1, 8, 8), (2, 1, 7, 8), (4, 2, 1, 1), (7, 5, 1, 1), (None, 1, 8, 8)]
    assert got == sorted(expected, key=repr)
    assert by_text(decontam.leaks(docs(spark, rows), items, broadcast_rows=0), "doc_id", "item_id", "n_common", "n_item") == got
    assert sorted(r["doc_id"] for r in decontam.clean(docs(spark, rows), items).collect()) == [3, 5, 6]
    assert decontam.leaks(docs(spark, rows), items.limit(0)).count() == 0 and decontam.leaks(docs(spark, []), items).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << k for k in range(64) if hashes and 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    rows += [(100000 + i, t) for i, (_, t) in enumerate(TEXTS)] + [(None, "no id here"), (100, "repeated id")]
    out = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = {t: brute_fingerprint(t) for _, t in rows}
    assert sorted((r["doc_id"], r["fp"] % 2**64) for r in out if r["doc_id"] is not None) == sorted((i, prints[t]) for i, t in rows if i is not None)
    ids = [i for i, _ in rows if i is not None]
    fp = np.array([prints[t] for i, t in rows if i is not None], np.uint64)
    assert {(r["doc_id"], r["component_id"]) for r in out if r["doc_id"] is not None} == set(zip(ids, brute_components(fp, np.array(ids), 4)))


def brute_components(fp, ids, distance):
    link = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    comp = ids.copy()
    while True:
        new = np.array([comp[x].min() for x in link])
        if (new == comp).all():
            return comp.tolist()
        comp = new


@pytest.mark.parametrize("cell", [2048, 64])
def test_links_keep_components_of_dense_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(8)
    out = list(rng.integers(0, 2**63, 200, dtype=np.uint64))
    for _ in range(700):
        x = out[rng.integers(0, len(out))] if rng.random() < 0.5 else out[0]
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            x = x ^ np.uint64(1 << int(bit))
        out.append(x)
    fp = np.unique(np.array(out, np.uint64))
    ids = np.arange(len(fp))
    named = spark.createDataFrame([(int(f.astype(np.int64)), int(i)) for f, i in zip(fp, ids)], "fp long, node long")
    roots = dict(components.components(simhash.links(named)).collect())
    assert [roots.get(int(i), int(i)) for i in ids] == brute_components(fp, ids, 4)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 900), (1000, 1001), (1001, 1000), (None, 3)], "a long, b long")
    got = dict(components.components(edges).collect())
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(6)]
    # Null ids of one text, a repeated row, and an id with a copy of document 3 and a text of its own.
    rows = [(None, text[0])] * 4 + [(None, text[1]), (2, text[2]), (2, text[2]), (3, text[3]), (5, text[3]), (5, text[4]), (9, text[1])]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows).repartition(3), "")
    assert by_text(kept, "doc_id", "text") == sorted([(None, text[0]), (2, text[2]), (3, text[3]), (5, text[4]), (9, text[1])], key=repr)
    assert kept.columns == corpus_pipeline.COLUMNS
    item = text[5].split()[:24]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    halves = [" ".join(item[:14]), " ".join(item[10:])]
    rows = [(None, "a " + text[5]), (None, text[0]), (7, text[5]), (7, text[1]), *((None, x) for x in halves), *((8, x) for x in halves)]
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs(spark, rows), str(tmp_path))
    assert by_text(clean, "doc_id", "text") == sorted([(None, text[0]), (7, text[1]), *((i, x) for i in (None, 8) for x in halves)], key=repr)
    assert clean.columns == corpus_pipeline.COLUMNS


def test_pipeline_decisions_take_effect(spark):
    import corpus_pipeline

    sf = DATA
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows.items()}
    kept = np.array([prints[i] for i in out], np.uint64)
    assert ((np.bitwise_count(kept[:, None] ^ kept[None, :]) <= 4).sum(axis=1) == 1).all()
    leaked = {r["doc_id"] for r in decontam.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not leaked & set(out)
    for i, r in out.items():
        assert r["decoded_sha256"] == hashlib.sha256(pii.masked(rows[i]).encode()).hexdigest()
    assert len(out) > 0.7 * len(rows)
