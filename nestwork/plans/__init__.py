"""From declared relations to DataFrame plans."""
