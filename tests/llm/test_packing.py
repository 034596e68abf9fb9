import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from briefloom.llm import packing

SCHEMA = "doc_id long, text string, piece string, grp int"


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "Hello, world!  \r\n\tx", "naïve Größe 東京 🙂 ́a", "it's we'll I'd 12345 ...", " " * 50] + [" ".join(rng.choice(["alpha", "beta,", "12", "ñandú", "x\n\ny"]) for _ in range(rng.choice([3, 200, 6000]))) for _ in range(30)]
    docs = [*enumerate(texts), (None, "no key"), (3, "again")]
    rows = packing.pack(spark.createDataFrame([(*d, "p", 1) for d in docs], SCHEMA)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= sum(r["length"] for r in rows) / 2048 * 1.05 + 2


def test_sum_of_squares_places_all():
    lengths = np.random.default_rng(3).integers(1, 101, 5000)
    sequence, offset = packing.place(lengths, 100)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 100 and len(used) <= np.ceil(lengths.sum() / 100) * 1.01
    assert packing.place(np.zeros(0, np.int64), 100)[0].size == 0
    assert packing.place(np.array([100, 100]), 100)[0].tolist() == [0, 1]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def _want(docs, ids_of):
    for key, text in docs:
        ids = np.array([*ids_of(text), 0], "<u4")
        yield key, len(ids), zlib.crc32(ids.tobytes())


def test_added_tokens_have_their_ids(spark):
    token = "<|endoftext|>"
    texts = [f"a {token} b", token, token * 3, f"  {token}  \n{token}x", f"end of one.\n\n{token}\n\nNext  {token}", "<|endoftext", "<|endoftext|", "<|fim_prefix|> <|ENDOFTEXT|>", f"<|endof{token}text|>", f"ñ {token}東京 {token}'s"]
    docs = [*enumerate(texts)]
    frame = spark.createDataFrame([(*d, "p", 1) for d in docs], SCHEMA)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    assert encode(texts[0]) == [64, 220, 50256, 275]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(frame).collect()) == list(_want(docs, encode))
    none = packing.ranks_encoder(packing.default_ranks())
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(frame, added={}).collect()) == list(_want(docs, none.encode_ordinary))


def _sums(counts):
    return sum(c * c for gap, c in counts.items() if gap)


def test_placing_follows_the_rule():
    """Against trying every gap: the one after which the squared counts of open sequences per gap sum to the least."""
    rng = np.random.default_rng(6)
    for room, sizes in ((20, rng.integers(1, 21, 400)), (50, rng.choice([3, 7, 11, 24, 50], 300)), (9, np.full(30, 4))):
        sequence, offset = packing.place(sizes, room)
        gaps, counts = {}, defaultdict(int)
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, best = int(sizes[i]), None
            for gap in sorted(g for g, c in counts.items() if c and g >= size):
                after = dict(counts)
                after[gap] -= 1
                after[gap - size] = after.get(gap - size, 0) + 1
                if best is None or _sums(after) < best[0]:
                    best = (_sums(after), gap)
            at, gap = int(sequence[i]), room if best is None else best[1]
            assert (at not in gaps) == (best is None)
            assert gaps.get(at, room) == gap and offset[i] == room - gap
            if best is not None:
                counts[gap] -= 1
            gaps[at] = gap - size
            counts[gap - size] += 1
