"""Where change logs come from: tables, binary logs, files of a store."""
