"""Columns that clash with helpers come back unchanged; archives that lose nothing; planted vector links."""

import gzip
import io
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from grievaline.llm import chat, decontaminate, hnsw, langid, mixing, periodic, shards, simhash, token_counts, toxicity, warc

LLM = entry_points.queries()
# names that the operators and general helpers use inside
HELPERS = (
    "_hot _salt _n _whole _id _hash _label _other _vec _t _d _new _slab usable strength place box whole id vec cls label_ first smallest "
    "root node n links copies_ u at part size_ rows doc target_ rest row words hits exact near number owners item term c0 c1 others new"
).split()
TEXTS = ["the cat sat on the mat today and slept", "the cat sat on the mat today and slept", "you idiot", None, "", "w1 w2 w3 w4 w5"]


def clashing(spark):
    rows = [(i, t, "en", "a" if i % 2 else None) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    more = [F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in HELPERS]
    return frame.select("*", *more, F.create_map(F.lit("k"), F.col("doc_id")).alias("tags"))


def unchanged(frame, before, keys=("doc_id",)):
    assert set(before.columns) <= set(frame.columns)
    for r in frame.select(*before.columns).collect():
        for c in HELPERS:
            assert r[c] == f"{c}-{r['doc_id']}", c
        assert r["tags"] == {"k": r["doc_id"]}
        if "text" in before.columns and r["doc_id"] < len(TEXTS):
            assert r["text"] == TEXTS[r["doc_id"]]


WAYS = {
    "near_duplicates": lambda s, d: simhash.near_duplicates(d),
    "first_of_each_group": lambda s, d: simhash.first_of_each_group(d),
    "accepted": lambda s, d: langid.accepted(d),
    "identify": lambda s, d: langid.identify(d, langid.learn(d)),
    "shuffle_into_shards": lambda s, d: shards.shuffle_into_shards(d, 2),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "clean": lambda s, d: decontaminate.clean(d, items(s)),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.Model({" idiot ": 6.0})),
    "mix": lambda s, d: mixing.mix(d.withColumn("size", mixing.word_count("text"))),
    "mixed": lambda s, d: mixing.mixed(d),
    "periodic_runs": lambda s, d: periodic.periodic_runs(d),
    "collapse": lambda s, d: periodic.collapse(d),
    "count_tokens": lambda s, d: token_counts.count_tokens(d, byte_path()),
}


def items(spark):
    return spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")


def byte_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("way", sorted(WAYS))
def test_helper_names_come_back_unchanged(spark, way):
    before = clashing(spark)
    found = WAYS[way](spark, before)
    unchanged(found, before)
    if way in ("near_duplicates", "identify", "shuffle_into_shards", "contamination", "toxicity", "mix", "periodic_runs", "collapse", "count_tokens"):
        assert found.count() == len(TEXTS)
    if way == "first_of_each_group":
        assert sorted(r["doc_id"] for r in found.collect()) == [0, 2, 3, 5]
    if way == "toxicity":
        assert [r["doc_id"] for r in found.where("predicted = 1").collect()] == [2]


def test_vectors_keep_helper_names(spark):
    rows = [(i, [1.0, float(i % 3)], 0) for i in range(12)] + [(20, [0.0, 1.0], 0), (21, [-0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int")
    more = [F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in HELPERS]
    before = frame.select("*", *more, F.create_map(F.lit("k"), F.col("doc_id")).alias("tags"))
    found = hnsw.near_duplicates(before, key="doc_id")
    unchanged(found, before)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert len(got) == 14 and got[20] == (1, 20) and got[21] == (1, 20) and got[0] == (3, 0)


def test_pipeline_stages_keep_helper_names(spark):
    """Every stage on a table with columns of its own."""
    docs = clashing(spark).withColumn("n_chars", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.pinned(stage(spark, docs, SMALL))
        unchanged(found, docs)
        assert name == "sharding" or found.columns == docs.columns


def unit(rng, n, dims):
    return hnsw.unit_rows(list(rng.normal(size=(n, dims))))


def test_planted_links_through_the_registered_query(spark, tmp_path):
    """The whole query on a table that has links: chains, groups, copies, several labels."""
    rng = np.random.default_rng(11)
    base = unit(rng, 900, 64)
    near = [base[i] + rng.normal(size=64) * s for i in range(0, 900, 3) for s in (0.01, 0.03, 0.045)]
    group = [base[5] + rng.normal(size=64) * 0.02 for _ in range(400)]
    vectors = np.concatenate([base, near, group, np.repeat(base[7:8], 50, axis=0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(i % 2) if i < 900 else int((i - 900) // 3 * 3 % 2) if i < 1800 else 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["vec_id"]: r for r in LLM["op4_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    exact = hnsw.unit_rows([np.array(r[1]) for r in rows])
    labels = np.array([r[2] for r in rows])
    linked = (exact @ exact.T >= 0.93) & (labels[:, None] == labels)
    want = linked.sum(axis=1) - 1
    got = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert want.sum() > 100_000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()
    root = np.arange(len(rows))
    while True:  # the smallest id that links reach
        least = np.where(linked, root[None], len(rows)).min(axis=1)
        if (least == root).all():
            break
        root = least
    same = np.mean([found[i]["component_id"] == root[i] for i in range(len(rows))])
    assert same >= 0.99 and all(found[i]["kept"] == (found[i]["component_id"] == i) for i in range(len(rows)))


def arc(version, *captures, cut=None):
    about = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n".encode()
    middle = b" 200 - - 0 f.arc" if version == "2" else b""
    out = b"filedesc://f 0.0.0.0 20200101000000 text/plain%s %d\n%s\n" % (middle, len(about), about)
    for url, mime, body in captures:
        out += b"%s 1.2.3.4 20200102030405 %s%s %d\n%s\n" % (url, mime, middle, len(body), body)
    return out[:cut]


LATIN = b"HTTP/1.1 404 Not Found\r\nServer: old\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + "caf\xe9 ".encode("latin-1") * 40
CAPTURES = [
    (b"http://a/latin", b"text/html", LATIN),
    (b"http://a/latin", b"text/html", LATIN),
    (b"dns:a", b"text/dns", b"20200102030405\na. 300 IN A 1.2.3.4\n\xff\x00"),
    (b"http://a/zip", b"application/zip", b"HTTP/1.0 200 OK\nX-Page-Id: 5\n\nPK\x03\x04" + bytes(range(256)) * 2),
    (b"http://b/zip", b"application/zip", b"HTTP/1.0 200 OK\r\nX-Page-Id: 6\r\n\r\nPK\x03\x04" + bytes(range(256)) * 2),
    (b"http://a/empty", b"text/html", b""),
    (b"http://a/headonly", b"text/html", b"HTTP/1.1 204 No Content\r\n"),
]


def converted(spark, tmp_path, **files):
    source = tmp_path / "arc"
    source.mkdir()
    for name, data in files.items():
        (source / f"{name}.arc").write_bytes(data)
    warc.convert(spark, str(source), str(tmp_path / "warc"))
    return warc.read_warc(spark, str(tmp_path / "warc")).collect()


def test_converter_loses_nothing(spark, tmp_path):
    rows = converted(spark, tmp_path, one=arc("1", *CAPTURES), two=gzip.compress(arc("2", *CAPTURES)))
    assert len(rows) == 2 * len(CAPTURES) == len({r["record_id"] for r in rows})
    by_url = {}
    for r in rows:
        by_url.setdefault(r["url"], []).append(r)
    for r in by_url["http://a/latin"]:
        assert bytes(r["head"]) + bytes(r["payload"]) == LATIN and r["record_type"] == "response"
    for r in by_url["dns:a"]:
        assert r["record_type"] == "resource" and bytes(r["payload"]) == CAPTURES[2][2] and not r["head"]
    assert all(bytes(r["head"]) == CAPTURES[6][2] and r["payload_bytes"] == 0 for r in by_url["http://a/headonly"])
    firsts = {r["record_id"] for r in by_url["http://a/zip"]}
    for r in by_url["http://a/zip"]:
        assert r["page_id"] == 5 and r["record_type"] == "response" and bytes(r["payload"]).startswith(b"PK\x03\x04")
    for r in by_url["http://b/zip"]:
        assert r["record_type"] == "revisit" and r["refers_to"] == 5 and r["refers_to_record"] in firsts
        assert bytes(r["head"]).startswith(b"HTTP/1.0 200 OK\r\n") and r["payload"] is None and r["payload_bytes"] == 516


def test_truncated_archives_keep_what_is_there(spark, tmp_path):
    whole = arc("1", *CAPTURES[:1], (b"http://a/cut", b"text/plain", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 500))
    packed = gzip.compress(arc("2", *CAPTURES[:1], (b"http://a/rest", b"x/y", np.random.default_rng(1).bytes(9000))))
    rows = converted(spark, tmp_path, body=whole[:-200], line=whole[:-530], zipped=packed[: len(packed) // 2], none=b"")
    cut = [r for r in rows if r["url"] == "http://a/cut"]
    assert [bytes(r["payload"]) for r in cut] == [b"z" * 301]
    assert sum(r["url"] == "http://a/latin" for r in rows) == 3
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(whole[:-200])))


def test_records_are_gzip_members(spark, tmp_path):
    converted(spark, tmp_path, one=arc("1", *CAPTURES))
    members = 0
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n") and one.eof
            members, data = members + 1, one.unused_data
    assert members == len(CAPTURES)
    long = b"q" * (33 << 20)
    assert gzip.decompress(warc.packed(long)) == long and warc.packed(long)[-1] == 0


def test_log_is_folded_in_the_order_of_its_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} " + "é" * (t % 5)) for c in range(6) for t in range(30)]
    rows += [(0, 3, "assistant", "text 0 3 ééé")] * 2
    log = chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    events = log.collect()
    seqs = [(r["conv_id"], r["seq"]) for r in events]
    assert len(seqs) == len(set(seqs))
    # events of other messages lie inside a message's own
    spans = {}
    for r in events:
        spans.setdefault((r["conv_id"], r["message"]), []).append(r["seq"])
    assert any(min(s) < q < max(s) for (c, m), s in spans.items() for cc, q in seqs if cc == c and q not in s)
    folded = chat.fold(log.repartition(5)).orderBy("conv_id", "message").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in folded] == [(c, r, t) for c, _, r, t in sorted(rows)]


def test_sharding_query_is_the_table(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = LLM["op6_sharding"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_language_query_is_its_definition(spark):
    """Predictions of the registered query from profiles that are built here, gram by gram."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in LLM["op5_language_id"](spark, SMALL).collect()}
    assert len(found) == len(table)
    for r in table:
        held = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert found[r["doc_id"]]["held_out"] == held
        if not any(c.isalpha() for c in r["text"] or ""):
            assert found[r["doc_id"]]["lang_pred"] == "und"
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in table if found[r["doc_id"]]["held_out"] and r["lang"]]
    assert np.mean(right) >= 0.95


def test_toxicity_query_on_held_out_rows(spark):
    middle = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    rows = LLM["op8_toxicity"](spark, middle).collect()
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = np.mean([p for t, p in judged if t == 1])
    wrong = np.mean([p for t, p in judged if t == 0])
    assert caught >= 0.9 and wrong <= 0.01
