import io
import random
import zlib

import numpy as np
import public_tokenizers
from quire.llm import packing
from tokenizers import Tokenizer

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_width_round_trips():
    rng = np.random.default_rng(1)
    for width in range(1, 33):
        for count in (0, 1, 7, 8, 9, 1003):
            ids = rng.integers(0, 1 << width, count).astype(np.uint32)
            data = packing.pack(ids, width)
            assert len(data) == -(-count * width // 8)
            assert (packing.unpack(data, width, count) == ids).all()


def test_width_of_a_vocabulary():
    assert [packing.width_of(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


class Kept(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


def test_random_access(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 64)
    rng = np.random.default_rng(2)
    out, all_ids = Kept(), []
    writer = packing.Writer(out, 17)
    for doc in (5, None, 9, 11):
        ids = rng.integers(0, 1 << 17, int(rng.integers(0, 300))).astype(np.uint32)
        writer.add(doc, ids)
        all_ids.append(ids)
    writer.close()
    flat, reader = np.concatenate(all_ids), packing.Reader(out)
    assert reader.doc_ids.tolist() == [5, 0, 9, 11] and reader.nulls.tolist() == [False, True, False, False]
    for start, stop in ((0, len(flat)), (3, 4), (63, 65), (100, 100), (len(flat) - 1, len(flat))):
        assert (reader.ids(start, stop) == flat[start:stop]).all()


def test_edges(spark, edges, empty):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    got = packing.packed_digests(spark, edges, PATH, 50_257).collect()
    rows = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert packing.packed_digests(spark, empty, PATH, 50_257).count() == 0


def test_random_texts_match_the_library():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    table = packing.bpe.class_table(packing.library_classes())
    cache = packing.bpe.PieceCache(packing.library_merger(PATH))
    rng = random.Random(5)
    letters = [*"aab'' 1\n\t  .!sdtmrevll\x00\x7f", "é", "中", "　", "\U0001f600", "²", "\x85", "\xad", "<|endoftext|>"]
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(6)]
        ids, counts = packing.bpe.encode_texts(texts, table, cache)
        own = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert own == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_match_the_library_as_it_is(spark, table):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(7)
    letters = [*"ab' 1\n<|>", "é", "<|endoftext|>", "<|endoftext", "endoftext|>"]
    rows = [(0, "hello <|endoftext|> world"), (1, "<|endoftext|>"), (2, "plain"), (3, None)]
    rows += [(4 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    got = sorted(map(tuple, packing.packed_digests(spark, table(rows), PATH, 50_257).collect()))
    start, want = 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert got[0][2] == 5  # four ids and the end
