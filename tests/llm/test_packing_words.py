"""What the word encoder of packing hands to the vocabulary, and at white space of all kinds."""

import random

from turnmill.llm.packing import WordEncoder, byte_bpe_path


def counted(encoder):
    """Strings and characters that the vocabulary gets from now on."""
    seen, whole = [0, 0], encoder.whole

    def told(texts):
        seen[0] += len(texts)
        seen[1] += sum(map(len, texts))
        return whole(texts)

    encoder.whole = told
    return seen


def test_distinct_words_go_to_the_vocabulary_in_one_string():
    words = [f"w{k}x{k * k}" for k in range(4000)]
    encoder = WordEncoder(byte_bpe_path())
    seen = counted(encoder)
    texts = [" ".join(words[k : k + 2000]) for k in range(0, 2000, 100)]
    encoder.encode(texts)
    assert seen[0] <= len(texts) + 1


def test_white_space_elsewhere_in_a_text_leaves_its_words_apart():
    words = [f"word{k}" for k in range(500)]
    encoder = WordEncoder(byte_bpe_path())
    seen = counted(encoder)
    texts = [f"t{k}\t " + " ".join(words) + "  " for k in range(50)]
    encoder.encode(texts)
    assert seen[1] < 2 * len(texts[0])


def test_ids_at_white_space_of_all_scripts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    rng = random.Random(2)
    bits = [" ", " ", " ", "\n", "a", "é", "中", "’", "\0", "\x1f", "\x85", "\xa0", " ", "᠎", " ", " ", " ", "　", "'s", "7", "<|endoftext|>"]
    texts = ["", " ", "  a", " a", "\n", "a ", "a\n", "\xa0", " <|endoftext|>", "<|endoftext|>", "b <|endoftext|><|endoftext|> c"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for encoder in (WordEncoder(byte_bpe_path()), WordEncoder(byte_bpe_path(), max_words=7)):
        ids, ends = encoder.encode(texts)
        for k, text in enumerate(texts):
            assert list(ids[ends[k] : ends[k + 1]]) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert [list(x) for x in encoder.encode([])] == [[], [0]] and list(encoder.encode(["", ""])[1]) == [0, 0, 0]
