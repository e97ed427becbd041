"""Writers and record formats."""
