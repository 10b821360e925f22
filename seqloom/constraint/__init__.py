"""How likely a sequence is still to satisfy a constraint, under a model."""

from seqloom.constraint.scoring import Constraint, decode, next_tokens, overlaps, reweight, satisfaction

__all__ = ["Constraint", "decode", "next_tokens", "overlaps", "reweight", "satisfaction"]
