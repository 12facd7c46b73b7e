import json

from lumengrist.cli import main

from .conftest import SF


def test_session(spark, capsys):
    main(SF, ["/k onbl\n", "thintion worthless\n", "/x\n", "/help\n", "\n", "/quit\n", "never\n"])
    out = capsys.readouterr().out.splitlines()
    assert all(isinstance(w, str) for w in json.loads(out[0]))
    assert set(json.loads(out[1])[0]) == {"abstract", "id", "link", "title"}
    assert out[2].startswith("unknown command")
    assert len(out) == 7
