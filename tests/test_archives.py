import io
import random
import zipfile

import pytest

from scholia.sources import archives

PARTS = {"[Content_Types].xml": '<Override ContentType="application/vnd.ms-word.document.macroEnabled.main+xml"/>', "word/document.xml": "text " * 500, "word/media/a.bin": bytes(random.Random(1).randbytes(5000)), "empty": ""}


def packed(parts, method=zipfile.ZIP_DEFLATED, streamed=False):
    out = io.BytesIO()
    if streamed:
        out.seekable = lambda: False  # sizes follow the members then
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
@pytest.mark.parametrize("streamed", [False, True])
def test_whole_archives_pass_unchanged(method, streamed):
    data = packed(PARTS, method, streamed)
    assert [e.name for e in archives.check(data)] == list(PARTS)
    assert archives.without_macros(data) is data


def test_every_flipped_byte_of_a_member_is_found():
    data = packed(PARTS)
    begin, end = archives._body(data, archives.directory(data)[2])
    for at in random.Random(2).sample(range(begin, end), 40):
        bad = bytearray(data)
        bad[at] ^= 1 << at % 8
        with pytest.raises(archives.Broken, match="corrupt word/media/a.bin"):
            archives.check(bytes(bad))


def test_cut_ends_are_told_apart_from_other_files():
    data = packed(PARTS)
    for n in (len(data) - 1, len(data) - 30, len(data) // 2, 40):
        with pytest.raises(archives.Broken, match="truncated|corrupt"):
            archives.check(data[:n])
    for other in (b"", b"%PDF-1.7", b"<html>"):
        with pytest.raises(archives.Broken, match="no archive"):
            archives.check(other)


@pytest.mark.parametrize("streamed", [False, True])
def test_macros_go_and_the_rest_stays(streamed):
    data = packed({"word/vbaProject.bin": b"x" * 900, **PARTS, "xl/VBAPROJECT.BIN": b"y"}, streamed=streamed)
    out = archives.without_macros(data)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert z.testzip() is None and z.namelist() == list(PARTS)
        assert z.read("word/media/a.bin") == PARTS["word/media/a.bin"]
        assert b"wordprocessingml.document.main+xml" in z.read("[Content_Types].xml") and b"macroEnabled" not in z.read("[Content_Types].xml")
    archives.check(out)
    old, new = ({e.name: e for e in archives.directory(x)} for x in (data, out))
    for name in ("word/document.xml", "word/media/a.bin"):  # packed bytes are the same ones
        a, b = archives._body(data, old[name]), archives._body(out, new[name])
        assert data[slice(*a)] == out[slice(*b)] and old[name].at != new[name].at


def test_rows(spark):
    good, macro = packed(PARTS), packed({**PARTS, "vbaProject.bin": b"x"})
    rows = [(1, good), (2, macro), (3, good[:-5]), (4, None), (5, b""), (6, packed({})), (None, good)]
    df = spark.createDataFrame(rows, "n long, bytes binary").withColumnRenamed("bytes", "content")
    got = {r.id: (r.members, r.macros, r.problem) for r in archives.judged(df, "content", "n").collect()}
    assert got == {1: (4, False, None), 2: (5, True, None), 3: (None, None, "truncated"), 4: (None, None, "no archive"), 5: (None, None, "no archive"), 6: (0, False, None), None: (4, False, None)}
    after = {r.id: bytes(r.content) if r.content is not None else None for r in archives.cleaned(df, "content", "n").collect()}
    assert after[1] == good and after[3] == good[:-5] and after[4] is None and len(archives.check(after[2])) == 4
