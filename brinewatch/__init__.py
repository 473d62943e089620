"""Sensor-beacon analytics expressed as Spark DataFrame jobs."""

from brinewatch.session import checked_broadcast, drop_scratch, scratch_dir, tune

__all__ = ["checked_broadcast", "drop_scratch", "scratch_dir", "tune"]
