"""Column expressions and small DataFrame patterns shared by every operator."""
