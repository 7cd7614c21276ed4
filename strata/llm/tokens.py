"""Tokenizer files, loaded once in each worker process."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

from strata.llm.memory import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")


def public_path(name: str) -> str:
    """Where the installed vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """The file's tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _own_bytes(token: str, byte: dict[str, int]) -> bytes:
    return bytes(byte[c] for c in token)


def _ranks(file: dict, suffix: str, marker: bytes, first: int) -> dict[bytes, int] | None:
    """Bytes of each token to its id, for merging by rank; None where that could differ from merging
    by pairs.

    Ranks must follow the merges (ids from `first` on). Merging by rank also joins two tokens whose
    bytes make a third one although that pair is no merge. It never meets such a pair if every token
    comes out whole when its own characters are merged: what two tokens went through inside a longer
    text before anything joined them to their neighbours is what they go through alone.
    """
    from tokenizers import Tokenizer, models

    model = file["model"]
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    byte, special = _byte_characters(), {t["content"] for t in file["added_tokens"]}
    own = {t: i for t, i in vocab.items() if t not in special}
    ends = {t for t in own if suffix and t.endswith(suffix)}
    for some, kind in ((ends, {"end_of_word_suffix": suffix}), (own.keys() - ends, {})):
        # Initial symbols are characters, so tokens with and without the suffix are merged apart.
        alone = Tokenizer(models.BPE(vocab=vocab, merges=merges, **kind))
        said = [t[: len(t) - len(suffix)] if t in ends else t for t in some]
        if any(e.ids != [vocab[t]] for t, e in zip(some, alone.encode_batch_fast(said, add_special_tokens=False), strict=True)):
            return None
    del alone, said
    give_back()
    return {(_own_bytes(t[: len(t) - len(suffix)], byte) + marker) if t in ends else _own_bytes(t, byte): i for t, i in own.items()}


@functools.cache
def encoder(path: str) -> Callable[[str], array]:
    """A function from a text to its ids as an array of unsigned 32-bit numbers.

    A byte-level BPE file whose ids follow its merges is given to the rank-based encoder, which
    does the same merges several times faster; any other file is used as it is.
    """
    ranked = _byte_level(path)
    if ranked is None:
        whole = tokenizer(path)
        return lambda text: array("I", whole.encode(text, add_special_tokens=False).ids)
    special = tuple(ranked._special_tokens)
    plain, full = ranked.encode_ordinary, ranked.encode

    def encode(text: str) -> array:
        if any(s in text for s in special):
            return array("I", full(text, allowed_special="all"))
        return array("I", plain(text))

    return encode


def _plain_tokens(file: dict) -> bool:
    model = file["model"]
    return (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


def _byte_level(path: str):
    import public_tokenizers
    import tiktoken

    file = _read(path)
    before = file["pre_tokenizer"] or {}
    simple = (
        _plain_tokens(file)
        and not file["model"].get("end_of_word_suffix")
        and file["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
    )
    ranks = _ranks(file, "", b"", 256) if simple else None
    if ranks is None:
        return None
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: The pattern of files whose words are runs of letters, single numbers, and runs of other marks.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which every library agrees about classes, lower case and normal form.
_SAFE = re.compile("[\t\n\x0b\x0c\r -~\xa0-\u012f\u0131-\u024f]*")


@functools.cache
def batch_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to their ids, as the file's tokenizer encodes each of them.

    A file of the kind that drops white space, lowers case and marks the ends of words is given to
    the rank-based encoder: a word goes in with a zero byte for its end. Texts with characters that
    libraries may see differently, a zero byte or a special token go to the tokenizer itself, and so do
    all texts for any other file.
    """
    import regex
    import tiktoken

    whole = tokenizer(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    file = _read(path)
    norm, pre = file["normalizer"] or {}, file["pre_tokenizer"] or {}
    wanted = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    simple = _plain_tokens(file) and file["model"].get("end_of_word_suffix") and norm.get("normalizers") == wanted and pre.get("type") == "Sequence"
    if simple:
        cut, byte_level = (pre["pretokenizers"] + [{}])[:2]
        simple = cut.get("type") == "Split" and cut.get("pattern") == {"Regex": _WORD_PATTERN} and cut.get("behavior") == "Removed" and cut.get("invert") and byte_level.get("type") == "ByteLevel" and not byte_level.get("use_regex") and not byte_level.get("add_prefix_space")
    ranks = _ranks(file, file["model"]["end_of_word_suffix"], b"\0", 512) if simple else None
    if ranks is None:
        return slow
    ranked = tiktoken.Encoding(os.path.basename(path), pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
    special, words, encode, safe = [t["content"] for t in file["added_tokens"]], regex.compile(_WORD_PATTERN).findall, ranked.encode_ordinary, _SAFE.fullmatch

    def fast(texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for t in texts:
            if safe(t) is None or ("<" in t and any(x in t for x in special)):
                out.append(None)
            else:
                found = words(t.lower())
                out.append(encode("\0".join(found) + "\0") if found else [])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, slow([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    return fast
