"""Ids of odd words equal the library's."""

import random
import string

import public_tokenizers
from tokenizers import Tokenizer

from groundshift.llm.queries import TOKENIZER
from groundshift.llm.tokens import WordEncoder

PATH = public_tokenizers.path(TOKENIZER)
LETTERS = "aAzZéÉßİıŞşĞğçÇΣσςΆάΰЖжйЙµªºﬁŉǅDENLVS" + "̧́̇̈ͅ" + "0123٣५½²" + ".,.,.,;-'’!?()" + "  \t\n ​　日本"


def test_ids_equal_the_library():
    rng, words, library = random.Random(9), WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 12))) for _ in range(100_000)]
    texts += ["DENİZLİ.", "VALİSİ,", "İ.", "ὈΔΥΣΣΕΎΣ.", "Ǆ,", "ȧ.", "ŉ.", "ﬁ.", "word.", "Straße,", "é.", "É,"]
    wrong = []
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        raw = words.document(text, b"")
        if [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] != whole.ids:
            wrong.append(text)
    assert wrong == []


def test_signs_after_words_need_no_full_run_and_single_words_no_memory():
    words, library = WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng, runs = random.Random(4), []
    stems = ["".join(rng.choice("abcdéüßµª") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [s + "".join(rng.choice(string.punctuation) for _ in range(rng.randint(1, 4))) for s in stems]
    texts += ["x<|endoftext|>", "x<|endoftext|>,", "<|endoftext|>%", "it's.", "'s'", "a'b%", "1%", "²%", "a1.%", "(a)%%", "é́.", "word%%% word## word%%%"]
    for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        raw = words.document(text, b"")
        assert [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] == whole.ids, text
    words, full = WordEncoder(PATH), words.encode
    words.encode = lambda w, **how: runs.append(w) or full(w, **how)
    before = len(words)
    words.document(" ".join(f"{s}%%% {s}zz,." for s in dict.fromkeys(stems)), b"")
    assert set(runs) <= {"%%%", ",.", *(s for s in stems if not s.islower())}
    assert len(words) - before <= 20
    words.document(" ".join(stems), b"")
    assert len(words) - before >= len(set(stems)) - 5


def test_texts_of_a_batch_look_up_each_different_piece_once():
    words, looked = WordEncoder(PATH), []
    texts = ["", " ", "\n", "word  word\n\nWORD word.", "été 日本 word", "<|endoftext|> word\n", "\n\n a\n", "x" * 90 + " word"]
    made = words.documents(texts, b"\1\0\0\0").to_pylist()
    assert made == [words.document(t, b"\1\0\0\0") for t in texts]

    class Counted(WordEncoder):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    Counted(PATH).documents(["word word word\nword"] * 50, b"")
    assert looked.count("word") == 1
