"""The library's queries over the driver's tables, by name."""

from beamframe.plans import arrays, bank_files, counting, decoding, interchange, joins, online, readout, reconstruction, selection, slow_control, tracking
from beamframe.plans.registry import REGISTRY as ALL

__all__ = ["ALL", "arrays", "counting", "decoding", "interchange", "joins", "online", "readout", "reconstruction", "selection", "slow_control", "tracking"]
