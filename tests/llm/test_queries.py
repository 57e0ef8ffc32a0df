"""The registered queries whose results SQL can't give, on the smallest tables: wiring, flags, and libraries' results."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, texts):
    rows = {r["doc_id"]: r.asDict() for r in queries.queries()[name](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    return rows


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


@pytest.mark.parametrize(("name", "cut"), [("op3_quality", 0.3), ("op4_toxicity", 0.5)])
def test_scores_and_flags(spark, texts, name, cut):
    rows = rows_of(spark, name, texts)
    assert all(r["held_out"] == (remainder(i, 5) == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows.values())
    assert len({r["score"] for r in rows.values()}) > 20


def test_language_model(spark, texts):
    rows = rows_of(spark, "op5_lm", texts)
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if remainder(i, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 10) == 0, len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_bpe_is_that_of_the_library(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = rows_of(spark, "op7_bpe", texts)
    for i, t in texts.items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_token_files_are_those_of_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, start = rows_of(spark, "op8_tokens", texts), 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
