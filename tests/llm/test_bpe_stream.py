import random

import pytest

from folioscope.llm import bpe_stream
from folioscope.llm.queries import tokenizer_path
from tests.llm.conftest import EDGE_TEXTS

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def samples():
    out = [t for _, t, _, _ in EDGE_TEXTS if t] + ["Hello's WORLD'll don't!!'s ΑΣ İstanbul", "ha" * 3000, "!" * 500,
                                                  "a<|startoftext|><|endoftext|>b", "́a Å"]
    dice = random.Random(7)
    out += ["".join(dice.choice(["th", "in", "an", "er", "on", "the", "a", "n", "'s ", "é", " "]) for _ in range(dice.randint(1, 300)))
            for _ in range(60)]
    return out


def test_ids_and_text_equal_the_library(library, small):
    for text in samples() + [r["text"] for r in small.limit(80).collect()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe_stream.encode_text(text, PATH) == ids
        assert bpe_stream.decode_ids(ids, PATH) == library.decode(ids, skip_special_tokens=False)


def test_the_stream_holds_little_and_gives_tokens_early():
    vocab = bpe_stream.vocabulary(PATH)
    stream, given, held = bpe_stream.StreamEncoder(vocab), [], 0
    for _ in range(300):
        given += stream.feed("thanonin" * 5)
        held = max(held, len(stream.last))
    assert len(given) > 1000 and held <= 8 * vocab.lookahead
    assert given + stream.finish() == [vocab.tokens[i] for i in bpe_stream.encode_text("thanonin" * 1500, PATH)]


def test_bytes_come_back_as_text():
    text = "naïve café 日本 !"
    assert bpe_stream.decode_ids(bpe_stream.encode_text(text, PATH), PATH, pieces=False).split() == text.split()


def test_edges(edge, nothing, library):
    rows = bpe_stream.encode(edge, PATH).collect()
    assert len(rows) == len(EDGE_TEXTS)
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in rows)
    want = []
    for doc_id, text, _, _ in EDGE_TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc_id), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_stream.encode(nothing, PATH).count() == 0
