"""Jobs J1-J10: compositions of the operators, one module each."""
