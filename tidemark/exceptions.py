"""Typed errors."""


class TidemarkError(Exception):
    """Base of all errors of this library."""


class DateDataError(TidemarkError):
    """Times out of order, deltas that don't fit their declared width or count, or a step that isn't positive."""


class DateUnitsError(TidemarkError):
    """Unknown time unit."""


class DateUnitsGranularityError(TidemarkError):
    """No finer or no coarser unit."""


class DataShapeError(TidemarkError):
    """Columns of one series differ in length."""


class DataDoesNotMatchTagDefinitionError(TidemarkError):
    """A declared column is missing or has another type."""


class InvalidPandasDataTypeError(TidemarkError):
    """A column type that a series can't hold."""


class InvalidPandasIndexError(TidemarkError):
    """An index that isn't a time."""


class CompressionError(TidemarkError):
    """A type that codecs don't take."""


class CompressionModeInvalidError(CompressionError):
    """A codec mode other than 'm' or 'e'."""


class IntegerWidthError(TidemarkError):
    """An integer outside the range of the asked kind."""


class NotIntegerException(TidemarkError):
    """A value that isn't integral."""


class CharConversionException(TidemarkError):
    """A value that isn't one character."""


class TagIdentifierByteRepresentationError(TidemarkError):
    """An identifier width that the file format can't hold."""


class CouldNotAcquireFileLockError(TidemarkError):
    """Another reader or writer held the file for too long."""
