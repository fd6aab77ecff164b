"""Table-to-table operators. None of them starts a job unless its text says so."""
