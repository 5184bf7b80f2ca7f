import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vertexflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "The quick brown fox doesn't jump. It's 2024!", "ÉCOLE Straße İstanbul ΣΊΣΥΦΟΣ éä", "中文 テスト 한국어 🙂🙂 नमस्ते",
    "<|startoftext|>hi<|endoftext|> <|endoftext", "a" * 700, "!?" * 400, "x\x1cy\x85z\xa0w v", "theethe" * 200, "\u0000\u0001 ok",
]


@pytest.fixture(scope="module")
def tok():
    return bpe.WordTokenizer(PATH), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("library", [False, True])
def test_ids_equal_the_library(library):
    own, reference = bpe.WordTokenizer(PATH, library), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    letters = "aabeeiinnorstthlldcé İΣσß中🙂'’.,!?-0123\n\t <|>\x85\x1c"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        assert [i for c in own.chunks(text) for i in own.chunk_ids(c)] == reference.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_and_false_specials(tok):
    own, reference = tok
    texts = [f"a{chr(c)}A." for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["\0<|ENDOFTEXT|>", "\0<|endoftext|>", "a<|endoftext|>\0b", "<|startoftext|><|STARTOFTEXT|>", "e\u0301 \u0301 \u1e9b\u0323"]
    for at in range(0, len(texts), 100_000):
        for text, other in zip(texts[at : at + 100_000], reference.encode_batch(texts[at : at + 100_000], add_special_tokens=False)):
            assert [i for c in own.chunks(text) for i in own.chunk_ids(c)] == other.ids, ascii(text)


def test_table_starts_anew(tok):
    small = bpe.WordTokenizer(PATH)
    small.automaton.most_states = 50
    for word in ("tokenization", "automaton", "transitions", "deterministically") * 3:
        assert small.chunk_ids(word) == tok[0].chunk_ids(word)
    assert len(small.automaton.rows) < 100


def test_automaton_equals_plain_merging():
    """All words of up to six letters under made-up merges, against merging by rank."""
    rng = random.Random(1)
    for _ in range(30):
        vocab, merges, tokens = {"a": 0, "b": 1, "c": 2}, [], ["a", "b", "c"]
        while len(merges) < 8:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                tokens.append(u + v)
        automaton = bpe.MergeAutomaton(vocab, merges)
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(150):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
            parts = list(word)
            while True:
                pairs = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert automaton.decode(automaton.encode(word)) == parts, (merges, word)


def test_round_trip_rows(spark, tok):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")], "doc_id long, text string, ids string")
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = tok[1].encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = tok[1].decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_encode_then_decode(spark, tok):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect():
        ids = tok[1].encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["text"] == tok[1].decode(ids, skip_special_tokens=False)


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({"a": 0, "b": 1, "ab": 2, "bb": 3, "abb": 4}, [("a", "b"), ("ab", "b"), ("b", "b"), ("a", "bb")][:0] + [("a", "b"), ("a", "b")])
