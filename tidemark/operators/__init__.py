"""DataFrame operators: sessions, roll-ups, comparisons, ledger, schedules."""
