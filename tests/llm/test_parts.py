"""Long texts in parts, cut where no tokenizer's piece goes on, in any script."""

import random
import resource

import public_tokenizers
import pytest
import tiktoken
import tokenizers

from webloom.llm import bpe, pieces, pretokenize

WORDS = ["the", "Don't", "we'LL", "x_y", "12", "3rd", "½", "ⅷ", "ΟΔΟΣ", "Σ", "straße", "İ", "ﬁ", "文字", "日本語テキスト", "한국어", "ภาษาไทย", "हिन्दी", "العربية", "éa", "́", "a‍", "👩‍👩‍👧", "<|endoftext|>", "«", "--", "'s", "'", "_"]
BREAKS = [" ", " ", " ", "  ", "\n", " \n", "　", " ", "", "", "。", "，", "、", ".", ", ", "!", "؟ ", "।", "(", ") "]


def texts():
    rng = random.Random(11)
    for _ in range(1_500):
        yield "".join(rng.choice(WORDS) + rng.choice(BREAKS) for _ in range(rng.randrange(2, 14)))


def libraries():
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    yield lambda t: whole.encode_ordinary(t)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
        library.no_truncation()
        library.no_padding()
        yield lambda t, library=library: library.encode(t, add_special_tokens=False).ids


def test_parts_encode_as_the_whole():
    cuts = 0
    for encode in libraries():
        for text in texts():
            found = pieces.parts(text, 1)
            assert "".join(found) == text
            cuts += len(found) - 1
            assert [i for part in found for i in encode(part)] == encode(text), (text, found)
    assert cuts > 5_000


def long_text(kind):
    sentence = {"Chinese": "这是一个没有空格的长句子，里面只有逗号和句号。", "Thai": "ภาษาไทยไม่มีช่องว่าง ระหว่างคำ", "numbers": "12345, 67890; 3.14 "}[kind]
    return sentence * (20_000_000 // len(sentence.encode()))


@pytest.mark.parametrize("kind", ["Chinese", "Thai", "numbers"])
def test_twenty_megabytes(kind):
    text = long_text(kind)
    assert max(map(len, pieces.parts(text))) < 1.01 * pieces.PART_CHARS
    model = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pretokenize.classes("tiktoken"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    values, _ = model.encode_long(text)
    assert model.decode(values[:1000])[0].tobytes().decode(errors="ignore") == text[: len(model.decode(values[:1000])[0].tobytes().decode(errors="ignore"))]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 700
