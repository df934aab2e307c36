"""Importing this package registers every query of the reference's operators."""

from . import catalog, coding, convert, fields, markers, metadata, recordings, rename, resampling, scalars, signals, spectra, tags  # noqa: F401
