"""Token alignment against a plain version that compares all byte ranges."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from llm_tables import documents
from tokenizers import Tokenizer

from ampere.llm import alignment

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TRICKY = ["a  b   c ", " lead", "x ", "  ", "\n\n a \n b", "é\u00a0 y\u00a0\u00a0 \u00a0z  \u00a0 w", "tab\t\t x", "don't he'll  's",
          "\u2581piece", "good \u2581 bad", "<s> </s><|endoftext|> <0x41>", "\U0001F600\U0001F600 e\u0301 \ufb01 \u3000 wide", "a\x00b \x1c c",
          "1234567 3.14 !!! ... --- ===", "   spaces   inside    of     it", "\r\nwindows\r\n", "\x85 next \x85line"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    letters = alignment._byte_level()
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        own_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        own_b = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (own_a, own_b) if b"".join(t for _, t in own_a) == whole == b"".join(t for _, t in own_b) else ([], [])

    def spans(toks):
        at, out = 0, []
        for i, t in toks:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    def align(texts):
        """Rows as the operator's, in the order of the texts."""
        rows, counts = [], collections.Counter()
        for text in texts:
            sa, sb = (spans(t) for t in tokens(text))
            links, j = [], 0
            for i, lo, hi in sa:
                while sb and sb[j][2] <= lo:
                    j += 1
                k = j
                while k < len(sb) and sb[k][1] < hi:
                    links.append((i, sb[k][0]))
                    k += 1
            ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
            groups, pa_, pb = [], 0, 0
            for e in ends:
                qa, qb = pa_, pb
                while qa < len(sa) and sa[qa][2] <= e:
                    qa += 1
                while qb < len(sb) and sb[qb][2] <= e:
                    qb += 1
                groups.append(",".join(str(t[0]) for t in sa[pa_:qa]) + "|" + ",".join(str(t[0]) for t in sb[pb:qb]))
                pa_, pb = qa, qb
            counts.update(links)
            rows.append((len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if sa else ""))
        best = collections.Counter()
        for (_, b_id), n in counts.items():
            best[b_id] = max(best[b_id], n)
        return [(n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)
                for n_a, n_b, n_g, links, sha in rows]

    return align


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _check(df, plain, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(i), *r) for (i, _), r in zip(rows, plain([t for _, t in rows])))
    got = alignment.align_documents(df, *PATHS, **kw)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got.collect()) == want


def test_documents(small, plain):
    _check(small, plain)


def test_tricky_texts(spark, plain):
    _check(documents(spark, list(enumerate(TRICKY)) + [(3, "x "), (None, "don't")]), plain)


def test_odd_rows_and_turns(odd, empty, plain):
    _check(odd, plain)
    _check(odd, plain, turn_pairs=7)  # counts joined back in many turns
    assert alignment.align_documents(empty, *PATHS).collect() == []


def test_hot_text(spark, plain):
    _check(documents(spark, [(k, "the very same text" if k % 3 == 0 else f"text number {k}") for k in range(300)]), plain)
