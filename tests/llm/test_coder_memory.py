"""What a Python worker holds on to after byte-level BPE: it stays alive beside the stages that follow."""

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from strandline.llm import bpe

from .test_operators import RANKS


def test_coder_keeps_what_is_in_use_and_little_else(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 300)
    coder = bpe.Coder(RANKS, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    merged = []
    contract = coder._contract
    coder._contract = lambda part, query: (merged.extend(s for s, _ in part), contract(part, query))
    for k in range(12):  # each text has 100 words of its own and one that all texts have
        text = " zzyzxqvj" + "".join(f" qx{chr(97 + k)}vz{chr(97 + i // 10)}{chr(97 + i % 10)}j" for i in range(100))
        ids = coder.encode([text, "", text])
        assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in ids] == [own.encode_ordinary(text), [], own.encode_ordinary(text)]
        assert coder.decode(ids) == [text.encode(), b"", text.encode()]
        for cache in (coder.chunks, coder.pieces):
            # Two generations, each overrun by one batch at most.
            assert len(cache) + len(getattr(cache, "before", ())) <= 2 * (300 + 400)
        getattr(coder, "rest", int)()
    assert len(coder.chunks) + len(getattr(coder.chunks, "before", ())) < 12 * 101  # some have gone
    assert merged.count(" zzyzxqvj") == 1  # but none in use


def test_no_database_stays_open_between_tasks(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text")).repartition(4)

    def look(batches):
        import pyarrow as pa

        from strandline.llm import bpe

        for _ in batches:
            pass
        held = list(bpe._coders.values())
        yield pa.RecordBatch.from_pydict({"coders": [len(held)], "open": [sum("db" in vars(c) for c in held)]})

    for _ in range(2):  # opened again
        assert bpe.encode_documents(docs, RANKS, P.PATTERN).filter(F.col("decoded").cast("string").startswith("some text ")).count() == 40
    seen = spark.range(4).repartition(4).mapInArrow(look, "coders bigint, open bigint").agg(F.sum("coders").alias("coders"), F.sum("open").alias("open")).first()
    assert seen.coders > 0 and seen.open == 0
