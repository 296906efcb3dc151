import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from bookflow.llm import packing
from tests.llm.helpers import ODD, documents


def check(docs, rows, waste):
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, []).append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for d, all_ids in want.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[d])
        expect = sorted((low, len(p := ids[low : low + 4096]), zlib.crc32(p.tobytes()), len(ids)) for ids in all_ids for low in range(0, len(ids), 4096))
        assert left == expect
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 4096
    used = sum(n for p in by_seq.values() for _, n in p)
    assert used >= (1 - waste) * 4096 * (len(by_seq) - 1)


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], packing.pack(df).collect(), 0.01)


def test_odd_rows(spark):
    text = "Σίσυφος ΣΑΣ naïve é I'll don't x's ---- 12345 <|endoftext|> 　wide space \U0001f600 İstanbul \x1c z\x00z ﬁ"
    docs = [*ODD, (60, text), (61, text * 3), (62, "́ ́a"), (63, "a​b  c")]
    check([(r[0], r[1]) for r in docs], packing.pack(documents(spark, docs), group=5).collect(), 1)
    assert packing.pack(documents(spark, ODD).filter("doc_id > 99")).count() == 0


def test_tournament_is_first_fit():
    rnd = random.Random(4)
    sizes = np.array([rnd.randint(1, 4095) for _ in range(700)])
    bins, offsets = packing.first_fit_decreasing(sizes)
    room, n = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        if k == len(room):
            room.append(4096)
        assert (bins[i], offsets[i]) == (k, 4096 - room[k])
        room[k] -= sizes[i]


def test_encoding_by_words_is_the_tokenizers():
    rnd = random.Random(1)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    some = [*"abcTdéüßſKİσΣς'’.,!?*#-_<>|&;:()1²½ \n\t\r 　́​あ漢\U0001f600ͅǅ한", "'s", "'LL", "don't", "The", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "Ärger,", "ÜBER,", "Aİ.", "a=\u0338", "A\u030a,"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    ids, counts = packing.encode(pa.array(texts), packing.default_tokenizer())
    for text, own in zip(texts, np.split(np.frombuffer(ids, "<u4"), np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_no_ids():
    rnd = random.Random(5)
    few = packing.Encoder(packing.default_tokenizer(), most=3000)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) + rnd.choice(["", ",", "!"]) for _ in range(400)]
    for _ in range(30):
        some = list({rnd.choice(words) for _ in range(40)})
        for w, ids in zip(some, few.ids_of(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == few.tokenizer.encode(w, add_special_tokens=False).ids
        assert few.held < 3000 + 80 * 300


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  b\nc", None, "", "x y"]
    ids, counts = packing.encode(pa.array(texts), path)
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and np.frombuffer(ids, "<u4").tolist() == sum(want, [])


def test_kept_words_take_few_bytes():
    """Words come back in later portions: those that 16 MB hold are not encoded anew, ten times 20,000 of them."""
    kept = packing.Encoder(packing.default_tokenizer(), most=16_000_000)
    learn, learnt = kept.learn, []
    kept.learn = lambda words, *rest: learnt.extend(words) or learn(words, *rest)
    parts = [["".join(chr(97 + (n // 26**k) % 26) for k in range(4)) for n in range(low, low + 20_000)] for low in range(0, 200_000, 20_000)]
    for part in [*parts, *parts]:
        found = kept.ids_of(part)
        assert np.frombuffer(found[7], "<u4").tolist() == kept.tokenizer.encode(part[7], add_special_tokens=False).ids
    assert sorted(learnt) == sorted(sum(parts, []))
    assert kept.held <= 16_000_000


def test_words_longer_than_all_that_is_kept():
    few = packing.Encoder(packing.default_tokenizer(), most=1000)
    words = ["ab" * 2000, "cd", "", "e,f" * 900, "cd" * 3]
    for some in (words, words[::-1], words[1:3]):
        for w, ids in zip(some, few.ids_of(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == few.tokenizer.encode(w, add_special_tokens=False).ids
        assert few.held <= 1000
