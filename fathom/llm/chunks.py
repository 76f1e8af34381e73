"""Cuts texts where no token of the public pre-tokenising pattern can cross, so that parts can be cached."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from fathom.llm.common import Generations

#: A cut goes before a space that white space doesn't follow: the pattern always starts a match there.
CUT = regex.compile(r" (?=\S)")
ODD_SPACE = regex.compile(r" \s")
CACHED_LENGTH = 1024


def parts(text: str) -> list[str]:
    """parts whose concatenation is the text; the pattern's matches in the text are those in its parts."""
    found = CUT.split(text) if ODD_SPACE.search(text) or text.startswith(" ") or text.endswith(" ") else text.split(" ")
    return [found[0], *[" " + x for x in found[1:]]] if found[0] else [" " + x for x in found[1:]]


def distinct_parts(batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(parts, places, bounds): text i is the parts at places[bounds[i]:bounds[i + 1]]; few parts are listed twice.

    Cuts at every space at once; a text in which white space follows a space, or that ends in one, is cut by `parts`.
    """
    lists = pc.split_pattern(pa.array(batch, pa.large_string()), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    found = pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type)).to_pylist()
    first = bounds[:-1]  # every text has a first part, before which there is no space
    suspect = pc.match_substring_regex(words, r"^([^!-~]|$)").to_numpy(zero_copy_only=False)  # no word of visible ASCII begins here
    odd_word = np.zeros(len(words), bool)
    odd_word[suspect] = [x == " " or x[1].isspace() for x in (found[i] for i in np.flatnonzero(suspect).tolist())]
    odd = odd_word[at]
    odd[first] = False
    heads = words.take(pa.array(at[first])).to_pylist()
    at[first] = len(found) + np.arange(len(heads))
    found += heads
    odd_texts = np.flatnonzero(np.add.reduceat(odd, first, dtype=np.int64)).tolist() if odd.any() else []
    if odd_texts:
        cut = np.split(at, bounds[1:-1])
        for i in odd_texts:
            cut[i] = len(found) + np.arange(len(own := parts(batch[i])))
            found += own
        at, bounds = np.concatenate(cut), np.cumsum([0, *map(len, cut)])
    return found, at, bounds


def encode_batch(batch: list[str], cache: Generations, encode_parts) -> list[np.ndarray]:
    """Ids of each text. encode_parts: from a list of distinct parts to a list of little-endian uint32 bytes, as long."""
    if not batch:
        return []
    found, at, bounds = distinct_parts(batch)
    missing = cache.absent(found)
    cache.update(zip(missing, encode_parts(missing), strict=True))
    coded = list(map(cache.__getitem__, found))
    for part in missing:
        if len(part) > CACHED_LENGTH:  # what is that long doesn't recur, and a cache of few entries would hold much
            del cache[part]
    cache.age()
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    pool = np.frombuffer(b"".join(coded), "<u4")
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])]
    return np.split(ids, ends[bounds[1:-1]])
