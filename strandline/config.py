"""Options of a run and their rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Default adapters and chimeric sequences.
FORWARD = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCACIIIIIIIATCTCGTATGCCGTCTTCTGCTTG"
REVERSE = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATTT"
CHIMERAS = (
    "ACACTCTTTCCCTACACGTCTGAACTCCAG,ACACTCTTTCCCACACGTCTGAACTCCAGT,ACACTCTTTCCCTACACACGTCTGAACTCC,"
    "CTCTTTCCCTACACGTCTGAACTCCAGTCA,GAAGAGCACACGTCTGAACTCCAGTCACII,GAGCACACGTCTGAACTCCAGTCACIIIII,"
    "GATCGGAAGAGCACACGTCTGAACTCCAGT,AGATCGGAAGAGCACACGTCTGAACTCCAG,AGAGCACACGTCTGAACTCCAGTCACIIII,"
    "ACACGTCTGAACTCCAGTCACIIIIIIIAT,GTGCACACGTCTGAACTCCAGTCACIIIII,AGCACACGTCTGAACTCCAGTCACIIIIII,"
    "CGTATGCCGTCTTCTGCTTGAAAAAAAAAA"
)
COMPARED = 30  # bases of an adapter that are compared at most
FAST = 10  # bases after which a hopeless comparison stops
FAST_LIMIT = -8.0
MIN_LENGTH = 5


class OptionError(ValueError):
    """Options that do not go together."""


def padded(adapter: str) -> str:
    """Wildcards up to one more than the compared length."""
    return adapter.ljust(COMPARED + 1, "I") if len(adapter) <= COMPARED else adapter


@dataclass(frozen=True)
class Options:
    forward: str = FORWARD
    reverse: str = REVERSE
    chimeras: str = CHIMERAS
    keys: str = ""
    ikey: str = ""
    allow_missing: bool = False
    trim_key: bool = False
    ancient: bool = False
    loc: float | None = None
    scale: float | None = None
    trim_cutoff: int = 1
    phred64: bool = False
    auto: bool = False
    keep_original: bool = False
    aligned: bool = False
    umi_f: int = 0
    umi_r: int = 0
    umi_trim_f: int = 0
    umi_trim_r: int = 0
    umi_kept_reverse_from_start: bool = False
    seed: int = 1
    bam: bool = False
    uncompressed: bool = False
    outfile: str = ""
    #: set by adapter inference: the adapters stand as they are, without padding
    unpadded: bool = field(default=False, repr=False)

    def __post_init__(self):
        if self.auto and (self.forward != FORWARD or self.reverse != REVERSE):
            raise OptionError("adapters are either given or inferred")
        if (self.loc is None) != (self.scale is None):
            raise OptionError("the length prior needs both loc and scale")
        if self.loc is not None and self.ancient:
            raise OptionError("the length prior and partial overlaps exclude each other")
        if self.scale is not None and self.scale <= 0:
            raise OptionError("scale is positive")
        if self.keys.count(",") > 1:
            raise OptionError("at most two keys")
        if self.umi_trim_f and not self.umi_f or self.umi_trim_r and not self.umi_r:
            raise OptionError("bases after a barcode are trimmed with the barcode only")
        if min(self.umi_f, self.umi_r, self.umi_trim_f, self.umi_trim_r, self.trim_cutoff) < 0:
            raise OptionError("lengths are not negative")
        if not self.bam and (self.uncompressed or self.outfile):
            raise OptionError("an output file or its compression is set for BAM only")
        if self.keep_original and not self.bam:
            raise OptionError("originals are kept for BAM only")

    @property
    def offset(self) -> int:
        return 64 if self.phred64 else 33

    @property
    def prior(self) -> bool:
        return self.loc is not None

    @property
    def partial(self) -> bool:
        return self.ancient or self.prior

    @property
    def min_overlap(self) -> int:
        return 1 if self.prior else 10

    @property
    def cutoff(self) -> int:
        return 1 if self.prior else self.trim_cutoff

    @property
    def adapters(self) -> tuple[str, str]:
        pad = (lambda a: a.upper()) if self.unpadded else (lambda a: padded(a.upper()))
        return pad(self.forward), pad(self.reverse)

    @property
    def key_pair(self) -> tuple[str, str]:
        """One key serves both mates."""
        first, _, second = self.keys.upper().partition(",")
        return first, second or first

    @property
    def chimera_list(self) -> list[str]:
        """Tokens up to the first empty one, the forward adapter if it is none of them, without spaces, padded."""
        found = []
        for token in self.chimeras.upper().split(","):
            if not token:
                break
            found.append(token)
        if self.forward.upper() not in found:
            found.append(self.forward.upper())
        return [padded(c) for c in (t.replace(" ", "") for t in found) if c]

    @property
    def umi(self) -> bool:
        return bool(self.umi_f or self.umi_r)

    def with_adapters(self, forward: str, reverse: str) -> Options:
        """Inferred adapters: not padded, the chimeras unchanged."""
        kept = ",".join(self.chimera_list)
        return replace(self, forward=forward.upper(), reverse=reverse.upper(), chimeras=kept, auto=False, unpadded=True)
