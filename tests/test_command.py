"""The command line's flags."""

import pytest

from strandline.__main__ import main, understood
from strandline.config import OptionError


def test_flags():
    a, o, out = understood("-fq1 a -fq2 b -fqo p --umif 5 --umtf 1 --ancientdna -k ac,gt -i --trimCutoff 3 --seed 4 -t 2".split())
    assert (a.fq1, a.fq2, out, a.t) == ("a", "b", "p", 2)
    assert (o.umi_f, o.umi_trim_f, o.partial, o.key_pair, o.allow_missing, o.cutoff, o.seed) == (5, 1, True, ("AC", "GT"), True, 3, 4)
    _, o, out = understood("in.bam -o out.bam -u --keepOrig --loc 4 --scale 0.5".split())
    assert o.bam and o.uncompressed and o.keep_original and o.prior and out is None
    _, _, out = understood("-fq1 a -fqose m -fqosef f".split())
    assert out == {"merged": "m", "fail": "f"}
    assert understood(["-"])[0].input == "-" and understood(["x.bam"])[1].outfile == ""


@pytest.mark.parametrize("wrong", ["-fq1 a", "-fq1 a -fqo p -fqt t", "-fq1 a -fq2 b -fqose m -fqosef f", "-u", "-p -fq1 a -fqo p", "-fq1 a -fqo p -u", "x.bam -fq1 a -fqo p", "-fq1 a -fqo p --auto -f ACGT"])
def test_wrong(wrong, capsys):
    with pytest.raises(OptionError):
        understood(wrong.split())
    assert main(wrong.split()) == 1


def test_help(capsys):
    assert main([]) == 1 and "interleaved" in capsys.readouterr().out
