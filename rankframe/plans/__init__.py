from .broadcast import checked_broadcast, within_bound
from .ordinals import global_ordinal, keyed_ordinal, prefix_sums

__all__ = ["checked_broadcast", "within_bound", "global_ordinal", "keyed_ordinal", "prefix_sums"]
