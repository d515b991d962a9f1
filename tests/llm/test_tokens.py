import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anemos.llm import tokens as module
from anemos.llm._common import text_slices
from anemos.llm.tokens import Encoder, Reader, ended, file_system, files, read_documents, read_tokens, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(MODEL).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \t\n\r\x0b\x0c\u00a0\u2003\u3000\u0301\u0338\u0345'sdm.,ÉİΣßﬁ가각")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40), st.just("a <|endoftext|> <|startoftext|>b")), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(texts):
    encoder = Encoder(open(MODEL, encoding="utf-8").read())
    for _, _, buf, offs in text_slices(pa.array(texts, pa.string())):
        for _ in range(2):  # the second time all words are known
            ids, n = ended(*encoder(buf, offs), 2)
            want = [[*x, 2] for x in whole(texts)]
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(module, "KNOWN_WORDS", 3)
    encoder, text = Encoder(open(MODEL, encoding="utf-8").read()), "one two three four five"
    buf = np.frombuffer(text.encode(), np.uint8)
    for _ in range(3):
        assert encoder(buf, np.array([0, len(buf)]))[0].tolist() == whole([text])[0] and len(encoder.number) == 5


def test_words_of_letters_take_the_short_way_and_have_the_ids_of_whole_texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("abzAZéÉßÿªµ", k=rng.randint(1, 12))) + rng.choice(["", "", ",", ".", "..", ".,"]) for _ in range(3000)]
    others = ["don't", "a1", "a-b", ",a", "e\u0301", "Σσ,", "é\u0301.", "ﬁ", "a,b", "1,", "<|endoftext|>", "<|endoftext|>,"]
    encoder, asked = Encoder(open(MODEL, encoding="utf-8").read()), []
    encode = encoder.encode
    encoder.encode = lambda texts, **options: asked.extend(texts[0]) or encode(texts, **options)
    text = " ".join(words + others + words)
    buf = np.frombuffer(text.encode(), np.uint8)
    assert encoder(buf, np.array([0, len(buf)]))[0].tolist() == whole([text])[0]
    assert sorted(asked) == sorted(others)


def table(seed=1):
    rng = random.Random(seed)
    words = ["The", "quick", "brunâtre", "don't", "x" * 90, "1234", "\u00a0", "<|endoftext|>", "!?"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in rng.sample(range(5000), 400)]
    return rows + [(9001, None), (9002, ""), (9003, "long text " * 40_000), (None, "no id"), (8000, "same"), (8000, "same"), (8000, "other"), (-5, "first")]


@pytest.mark.parametrize("file_bytes,frame", [(64 << 20, 1 << 16), (3000, 64)])
def test_round_trip(spark, tmp_path, file_bytes, frame):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("id", "h", "lies", "file", "start", "ids"):  # clashing names
        df = df.withColumn(name, F.lit(777))
    write_tokens(df, str(tmp_path), MODEL, frame_ids=frame, file_bytes=file_bytes)
    got = sorted(read_tokens(spark, str(tmp_path)).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    encoded = dict()
    for (i, _), ids in zip(rows, whole([t for _, t in rows])):
        encoded.setdefault(i, []).append([*ids, 2])
    start = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        encoded[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"], r["crc"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not any(encoded.values())
    # any zstandard reader sees the same ids
    listed = sorted(files(spark, str(tmp_path)).collect(), key=lambda r: r["file"])
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "ids" / r["file"]).read_bytes()), read_across_frames=True).read() for r in listed)
    assert np.frombuffer(plain, "<u2").astype("<u4").tobytes() == b"".join(r["ids"] for r in got)
    wanted = spark.createDataFrame([(x,) for x in (9003, 9003, 8000, -5, 123456, None, 9001)], "doc_id long")
    some = read_documents(spark, str(tmp_path), wanted).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r)[:4] for r in got if r["doc_id"] in (9003, 8000, -5, 9001))


def test_only_asked_frames_are_read(spark, tmp_path):
    write_tokens(spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(200)], "doc_id long, text string"), str(tmp_path), MODEL, frame_ids=500)
    name = files(spark, str(tmp_path)).first()["file"]
    reader, seen = Reader(*_at(tmp_path, name)), []
    real = reader.at
    reader.at = lambda start, size: seen.append(size) or real(start, size)
    lo, hi = reader.bounds[7], reader.bounds[8]
    assert len(reader.ids(int(lo), int(hi))) == hi - lo and len(seen) <= 2
    assert len(reader.table) > 4 and sum(seen) < (tmp_path / "ids" / name).stat().st_size / 2


def _at(folder, name):
    fs, path = file_system(f"{folder}/ids")
    return fs, f"{path}/{name}"


def test_damage_is_seen(spark, tmp_path):
    write_tokens(spark.createDataFrame([(1, "words of a text")], "doc_id long, text string"), str(tmp_path), MODEL)
    name = files(spark, str(tmp_path)).first()["file"]
    path = tmp_path / "ids" / name
    sound = path.read_bytes()
    path.write_bytes(sound[:12] + bytes([sound[12] ^ 1]) + sound[13:])
    with pytest.raises(ValueError):
        Reader(*_at(tmp_path, name)).ids(0, 2)
    for cut in (sound[:-1], b"", sound[:20]):
        path.write_bytes(cut)
        with pytest.raises(ValueError):
            Reader(*_at(tmp_path, name))


def test_empty_table_and_text_ids(spark, tmp_path):
    df = spark.createDataFrame([("b", "two words"), ("a", None)], "name string, body string")
    write_tokens(df.where("false"), str(tmp_path / "none"), MODEL, id_col="name", text_col="body")
    assert read_tokens(spark, str(tmp_path / "none"), "name", "string").count() == 0
    write_tokens(df, str(tmp_path / "two"), MODEL, id_col="name", text_col="body")
    assert [tuple(r) for r in read_tokens(spark, str(tmp_path / "two"), "name", "string").select("name", "start", "n_tokens").orderBy("name").collect()] == [("a", 0, 1), ("b", 1, 3)]


def test_words_are_encoded_together():
    encoder, asked = Encoder(open(MODEL, encoding="utf-8").read()), []
    encode = encoder.encode
    encoder.encode = lambda inputs, **options: asked.extend(inputs) or encode(inputs, **options)
    text = " ".join(f"wörd{i}'s" for i in range(1500))
    buf = np.frombuffer(text.encode(), np.uint8)
    assert encoder(buf, np.array([0, len(buf)]))[0].tolist() == whole([text])[0] and len(asked) <= 3
