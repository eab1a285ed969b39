"""Named queries over the supplied tables and their ANSI-SQL oracles."""
