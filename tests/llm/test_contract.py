import brute
import duckdb
import pytest
from oracle import compare

from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, name, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) > 0


def test_decontamination(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = result(spark, "op1_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {d[0]: d[1:] for d in brute.decontaminate(docs, items)}
    assert any(x[-1] for x in got.values())


def test_quality(spark, docs):
    got = result(spark, "op3_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality_base(t) for i, t in docs}


def test_codec(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = result(spark, "op4_bpe_codec", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_licences(spark, docs):
    got = result(spark, "op5_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: brute.licence_base(t) for i, t in docs}


def test_repeats(spark, docs):
    got = result(spark, "op7_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == {d[0]: d[1:] for d in brute.repeats([(i, (t or "").encode()) for i, t in docs])}


def test_personal(spark, docs):
    got = result(spark, "op8_personal_data", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for i, t in docs:
        found = brute.personal(t)
        assert got[i] == (*[sum(s[0] == k for s in found) for k in ("email", "ip", "card", "phone")], brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)))


def test_near_duplicates(spark, docs):
    got = result(spark, "op9_simhash_near_dedup", "doc_id", "fingerprint", "component_id")
    values = [(i, brute.fingerprint(t)) for i, t in docs]
    group = brute.components(values)
    assert got == {i: (f"{v:016x}", group[i]) for i, v in values}


def test_placement(spark, docs):
    import hashlib

    from ledgerloom.llm import sharding

    owner = sharding.slot_owners(queries.SHARDS, queries.SLOTS)
    for i, (slot, shard) in result(spark, "op10_sharding", "doc_id", "slot", "shard").items():
        assert slot == int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % queries.SLOTS and shard == queries.SHARDS[owner[slot]]
