import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redpencil.llm import alignment as al

FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
RANKS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TEXTS = ["the quick brown fox", "the quick", "", None, " ", "  two  spaces\n\nand lines\t", "été 中文 \U0001F600", "a▁b", "<|endoftext|> <s></s> <0x41>",
         "x" * 3000, "don't I'll 12345 1٢3", "é nbsp here there", "\x00zero", "the quick brown fox", "𐍈 ﬁ ﬂ ½", "lorem ipsum dolor " * 2000]


def brute(rows):
    """Groups and links found byte by byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=FILES[1])
    letters = al._byte_letters()
    known = {k: t for t, k in first.get_vocab().items()}
    found, counts = [], Counter()
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in known[k]) for k in a]
        bytes_b = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((key, [], [], [], []))
            continue
        owner_a = [n for n, d in enumerate(bytes_a) for _ in d]
        owner_b = [n for n, d in enumerate(bytes_b) for _ in d]
        linked = [(a[x], b[y]) for x, y in sorted(set(zip(owner_a, owner_b, strict=True)))]
        counts.update(linked)
        groups, x0, y0 = [], 0, 0
        for at in range(1, len(owner_a) + 1):
            if at == len(owner_a) or (owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]):
                x1, y1 = owner_a[at - 1] + 1, owner_b[at - 1] + 1
                groups.append((a[x0:x1], b[y0:y1]))
                x0, y0 = x1, y1
        found.append((key, a, b, groups, linked))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for key, a, b, groups, linked in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(linked), sum(counts[p] == best[p[1]] for p in linked),
                    sum(counts[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str), {key: groups for key, _, _, groups, _ in found}


@pytest.mark.parametrize("block", [300, 4 << 20])
def test_statistics_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "an id twice")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, pair string, block int").repartition(3)
    want, _ = brute(rows)
    assert sorted(map(tuple, al.link_statistics(df, *FILES, *RANKS).collect()), key=str) == want
    assert sorted(map(tuple, al.link_statistics(df, *FILES).collect()), key=str) == want


def test_documents_groups_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, groups = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, al.link_statistics(docs, *FILES, *RANKS).collect()), key=str) == want
    for r in al.token_groups(docs, *FILES, *RANKS).collect():
        assert [(list(g.a), list(g.b)) for g in r.groups] == groups[r.doc_id]
    assert al.link_statistics(docs.limit(0), *FILES, *RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(0, 1000))
def test_cuts_of_random_ends(lengths, seed):
    ends_a = np.cumsum(lengths)
    inner = np.random.default_rng(seed).choice(np.arange(1, ends_a[-1] + 1), size=len(lengths) // 2 + 1)
    ends_b = np.unique(np.append(inner, ends_a[-1]))
    cuts = al.shared_cuts(ends_a, ends_b, np.array([0]), np.array([len(ends_a)]))
    assert ends_a[cuts].tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))


def test_both_libraries_agree_on_settled_characters():
    fast, slow = al.ByteTokens(FILES[0], *RANKS), al.ByteTokens(FILES[0])
    settled = [c for c in map(chr, range(0xD800)) if al._SETTLED.fullmatch(c)] + [c for c in map(chr, range(128)) if not al._SETTLED.fullmatch(c)]
    forms = [f"{x}{c}{y}" for c in settled for x in ("a", " ", "1", ".", "\n") for y in ("b", " ", "2", "!", c)]
    forms += [f"'{c}{d}" for c in "stremvldx" for d in "evl x"] + ["<|endoftext|>", " <|endoftext|>x"]
    assert fast(forms) == slow(forms)
    rng = np.random.default_rng(1)
    mixed = ["".join(rng.choice(settled, 60)) for _ in range(3000)]
    assert fast(mixed) == slow(mixed)
