"""Column expressions: calendar periods, text helpers, states, schedules."""
