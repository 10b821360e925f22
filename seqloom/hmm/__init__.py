"""Hidden Markov models over token sequences."""

from seqloom.hmm.model import Hmm

__all__ = ["Hmm"]
