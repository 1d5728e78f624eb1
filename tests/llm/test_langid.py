"""Language ID against a plain sum of compressed sizes, and what counts as a letter."""

import zstandard

from tidemark.llm import langid


def plain(content, text):
    """The contract read literally: every piece by every dictionary, the smallest sum, the first of equals."""
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    raw, sizes = langid.letters(text).encode(), {}
    for lang in sorted(content):
        own = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(c.compress(raw[a : a + langid.PIECE])) for a in range(0, len(raw), langid.PIECE))
    return min(sizes, key=lambda k: (sizes[k], k))


def test_table_matches_plain_sizes(docs, awkward):
    content = langid.sample(docs)
    for table in (docs, awkward):
        texts = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=repr)
        got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(table, content).collect()), key=repr)
        want = sorted(((k, plain(content, t)) for k, t in texts), key=repr)
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.01 * len(want)  # precomputed dictionaries match a little otherwise


def test_signs_are_no_letters():
    own = langid.Classifier({"en": b"some words of a language", "xx": b"other words"})
    for text in (None, "", "12 34", "\u00bd \u00b2", "\u2167", "_ - !", "\u0301"):
        assert own.predict(text) == ("und", 0.0, True)
    for text in ("a", "\u00e9", "\u6f22", "\u0915\u093e\u092e"):
        assert own.predict(text)[0] != "und"
    assert langid.letters("\u0915\u093f\u0924\u093e\u092c 12") == "\u0915\u093f\u0924\u093e\u092c "  # words of Indic scripts stay whole
