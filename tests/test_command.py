"""The command line on single files."""

import json

import pytest

from bitloom.__main__ import main


def test_commands(tmp_path, capsysbinary):
    layout, cell, value = tmp_path / "r.txt", tmp_path / "c.bin", tmp_path / "v.json"
    layout.write_text("@param shift: u8 @root struct R { n: u8, a: u8[n], @derived m: u32 = n + shift }")
    cell.write_bytes(b"\2AB")
    assert main(["parse", str(layout), str(cell), "shift=0x10"]) == 0
    assert json.loads(capsysbinary.readouterr().out) == {"n": 2, "a": [65, 66], "m": 18}
    value.write_text('{"n": 1, "a": [7]}')
    assert main(["produce", str(layout), str(value), "shift=1"]) == 0 and capsysbinary.readouterr().out == b"\1\7"
    assert main(["hexdump", str(cell)]) == 0 and b"00000000  02 41 42" in capsysbinary.readouterr().out
    assert main(["info", "gif"]) == 0 and b"struct DataSubBlock" in capsysbinary.readouterr().out
    assert main(["check", str(layout)]) == 0


@pytest.mark.parametrize("args", [[], ["parse"], ["fold", "x"], ["check", "/no/such/file"]])
def test_wrong_calls(args, capsys):
    assert main(args) in (1, 2) and capsys.readouterr().err


def test_diagnostics(tmp_path, capsys):
    (tmp_path / "r.txt").write_text("@root struct R { a: nowhere }")
    assert main(["check", str(tmp_path / "r.txt")]) == 1 and "BSC" in capsys.readouterr().err
    (tmp_path / "r.txt").write_text("@root struct R { a: u32 }")
    (tmp_path / "c.bin").write_bytes(b"\1")
    assert main(["parse", str(tmp_path / "r.txt"), str(tmp_path / "c.bin")]) == 1 and "PE101" in capsys.readouterr().err
