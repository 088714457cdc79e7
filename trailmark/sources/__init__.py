"""Where ledgers come from: adapter, workbooks."""
