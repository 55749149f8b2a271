"""Generic, column-parametrised DataFrame operators."""
