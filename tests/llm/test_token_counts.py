import pytest

from friction.llm.common import read_table
from friction.llm.token_counts import VOCABULARY, attribute, document_fields, encoding, spans_of, token_counts


def slow(fields, rule):
    """Token by token: the bytes of each, and the owner of each character."""
    record, start, end = spans_of(fields)
    encoder, _ = encoding(VOCABULARY)
    owner = ["sep"] * len(record)
    for i, (a, b) in enumerate(zip(start, end)):
        owner[a:b] = [i] * (b - a)
    byte_owner = [o for o, c in zip(owner, record) for _ in c.encode()]
    char_of = [k for k, c in enumerate(record) for _ in c.encode()]
    counts, at = {}, 0
    for t in encoder.encode_ordinary(record):
        n = len(encoder.decode_single_token_bytes(t))
        chars = sorted({char_of[b] for b in range(at, at + n) if b == 0 or char_of[b] != char_of[b - 1]}) or [char_of[at]]
        owners = [owner[c] for c in chars]
        o = owners[0] if rule == "first" else max(dict.fromkeys(owners), key=owners.count)
        counts[o] = counts.get(o, 0) + 1
        at += n
    assert at == len(byte_owner)
    return [counts.get(i, 0) for i in range(len(fields))], counts.get("sep", 0)


@pytest.mark.parametrize("rule", ["first", "majority"])
@pytest.mark.parametrize("fields", [["src0", "fr", "Été là", "a\n\n\nb  \n"], [None, "", "x", None], ["\n", " ", "\n\n", "日本語 テキスト"], ["a" * 5000, "b", "c  ", "  d"]])
def test_against_token_by_token(fields, rule):
    _, _, tokens, between, _ = attribute(fields, rule=rule)
    assert (tokens.tolist(), between) == slow(fields, rule)


def test_documents_add_up(spark, sf):
    docs = read_table(spark, sf, "documents").limit(100)
    got = token_counts(docs, document_fields()).collect()
    encoder, _ = encoding(VOCABULARY)
    texts = {r.doc_id: r for r in docs.collect()}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {})[r.field] = r
    for i, f in by.items():
        d = texts[i]
        title, _, body = d.text.partition("\n")
        record = "\n".join([d.source, d.lang, title, body])
        assert record[f["body"].start_char : f["body"].end_char] == body
        assert sum(x.tokens for x in f.values()) + f["body"].separator_tokens == f["body"].record_tokens == len(encoder.encode_ordinary(record))


def test_odd_rows(make_docs, odd_rows):
    assert token_counts(make_docs(odd_rows), document_fields()).count() == 4 * len(odd_rows)
    assert token_counts(make_docs([]), document_fields()).count() == 0
    with pytest.raises(ValueError):
        token_counts(make_docs([]), document_fields(), rule="other")
