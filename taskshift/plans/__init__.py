"""Named result tables, each a composition of DataFrame operators."""
