"""Rules written as text: compilation to Columns and evaluation over documents."""
