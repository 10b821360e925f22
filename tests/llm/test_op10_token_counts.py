import random

from seqloom.llm import op10_token_counts as op
from seqloom.llm.common import table


def greedy(word, inner, last):
    n = 0
    while word:
        for k in range(len(word), 0, -1):
            part = word[:k]
            if k == 1 or (part in last if k == len(word) else part in inner):
                word, n = word[k:], n + 1
                break
    return n


def test_random_vocabularies():
    rng = random.Random(5)
    for _ in range(60):
        pieces = {tuple(rng.choices(b"abc", k=rng.randint(1, 5))) + ((op.END,) if rng.random() < 0.4 else ()) for _ in range(rng.randint(1, 14))}
        inner, last = {bytes(p) for p in pieces if p[-1] != op.END}, {bytes(p[:-1]) for p in pieces if p[-1] == op.END}
        auto = op.Automaton(sorted(pieces))
        for _ in range(150):
            word = bytes(rng.choices(b"abcd", k=rng.randint(1, 14)))
            assert auto.count(word) == greedy(word, inner, last), (pieces, word)


def test_public_vocabulary_on_documents(spark, sf_dir):
    pieces = op.read_pieces(op.VOCABULARY)
    inner, last = {bytes(p) for p in pieces if p[-1] != op.END}, {bytes(p[:-1]) for p in pieces if p[-1] == op.END}
    docs = table(spark, sf_dir, "documents").limit(40)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in op.token_counts(docs).collect():
        words = [w for w in rows[r.doc_id].lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
        counts = [greedy(w.encode(), inner, last) for w in words]
        assert (r.n_words, r.n_tokens, r.longest) == (len(words), sum(counts), max(counts, default=0))


def test_hard_rows_and_empty(frame, hard):
    got = op.token_counts(frame(hard)).collect()
    assert len(got) == len(hard) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert op.token_counts(frame([])).count() == 0
