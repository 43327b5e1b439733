import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_rows import docs, labels, none  # noqa: F401
from postlens.llm import token_records as R
from postlens.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_library():
    t = Tokenizer.from_file(PATH)
    e = R.Encoder(open(PATH, encoding="utf-8").read(), 4)
    for x in ["J̌x É. é, <|endoftext|>a <|STARTOFTEXT|> don't DON'T I'LL x.,. 3,14 a\xa0b \x0b\x0c\x85 \x1c ΣΑΣ. İs",
              "áb é. ́x 日本語。 123.", "", "  \n", "x" * 3000, "Straße, ÿ. ×÷ ªº µ. don't. 1st."]:
        assert np.frombuffer(e.encode(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark, docs, none):
    t = Tokenizer.from_file(PATH)
    path = scratch(spark, "records")
    manifest = R.write_records(docs, PATH, path, end_id=2, file_bytes=64)  # small files: rolled over
    got = R.read_digests(manifest).collect()
    assert len(got) == docs.count() and manifest.count() > 3
    rows = sorted(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect(),
                  key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start = 0
    for r, g in zip(rows, sorted(got, key=lambda g: (g.start, g.n_tokens)), strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.id, g.start, g.n_tokens) == (None if r.doc_id is None else str(r.doc_id), start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    mixed = [(r.id, tuple(r.ids)) for r in R.read_shuffled(manifest, 1).collect()]
    assert len(mixed) == len(rows) and sorted(map(str, mixed)) != list(map(str, mixed))
    assert R.round_trip(none, PATH).count() == 0


def test_damage_is_noticed(tmp_path):
    body = R.pack_id("7") + np.array([5, 6], "<u2").tobytes()
    good = R.MAGIC + struct.pack("<I", 2) + R.frame(body)
    import io
    (width, back), = R.frames(io.BytesIO(good))
    key, ids = R.unpack(back, width)
    assert (key, ids.tolist()) == ("7", [5, 6])
    for k in (12, 20, 25, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(R.frames(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(R.frames(io.BytesIO(good[:-3])))


def test_ids_of_all_letters_and_random_strings_equal_the_library():
    import random
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    enc, lib = R.Encoder(spec, 2), Tokenizer.from_str(spec)
    texts = [x for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LMN" for x in (f"a{chr(c)},", f"{chr(c)}.")]
    pool = [chr(c) for c in [*range(33, 0x250), 0x130, 0x131, 0x307, 0x301, 0x308, 0x958, 0x9DC, 0xFB1D, 0x3A3, 0x1E9E, 0x212A, 0xAC00, 0x4E00]]
    rng = random.Random(1)
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 6))) + rng.choice(["", ".", ","]) for _ in range(50_000)]
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert all(enc.encode(t.encode()) == b"".join(i.to_bytes(2, "little") for i in w.ids) for t, w in zip(texts, want, strict=True))
