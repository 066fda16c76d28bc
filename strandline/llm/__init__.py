"""Operators for preparing training corpora: extraction, de-duplication, search, decontamination, counting, privacy,
scoring, mixing and filtering.  Nothing else in the library imports this subpackage."""
